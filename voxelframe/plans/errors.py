"""Errors raised before a job starts, or by checked access."""

from __future__ import annotations


class RasterError(Exception):
    """Base of this library's errors."""


class OutOfBoundsError(RasterError, IndexError):
    """A checked index, or a region, lies outside its bounds."""

    def __init__(self, name: str, value: object, bounds: tuple[object, object]) -> None:
        super().__init__(f"{name} out of bounds: {value} not in [{bounds[0]}, {bounds[1]}]")


class SizeError(RasterError, ValueError):
    """A number of values doesn't fit a shape, or two shapes differ."""

    def __init__(self, got: object, expected: object) -> None:
        super().__init__(f"size {got} where {expected} is expected")


class FileFormatError(RasterError):
    """A file can't be read as the format says."""


class PathMissingError(RasterError, FileNotFoundError):
    """Nothing to read at a path."""


class PathTakenError(RasterError, FileExistsError):
    """Something stands where a new file should go."""
