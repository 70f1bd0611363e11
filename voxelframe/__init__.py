"""Rasters as Spark DataFrames: regions, pixel-wise maths, stencils, resampling, spectra and files."""
