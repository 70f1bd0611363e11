"""Operators for preparing training text on Spark. Nothing else in this library imports this subpackage."""
