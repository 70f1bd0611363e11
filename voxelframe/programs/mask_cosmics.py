"""Mask cosmic rays in a FITS image and append the mask, or write it to another file."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark.sql import SparkSession

from ..operators.cosmics import mask_cosmics
from ..plans.steps import Options
from ..sources.fits import read_fits, write_fits


def gaussian_psf(radius: int, sigma: float) -> tuple[list[float], tuple[int, int]]:
    """Values of a round Gaussian in a square window, axis 0 fastest, and the window's shape."""
    d = np.arange(-radius, radius + 1) ** 2
    return np.exp(-(d[:, None] + d[None, :]) / (2 * sigma**2)).ravel().tolist(), (2 * radius + 1, 2 * radius + 1)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    options = Options("Mask cosmic rays in an image.")
    options.positional("image", "FITS file to read")
    options.named("output", "file for the mask; by default it is appended to the image's file", "-")
    options.named("hdu", "number of the image unit", 0, int)
    options.named("pfa", "probability of false alarms", 0.01, float)
    options.named("quotient", "largest likeness to the point spread function", 0.5, float)
    options.named("rounds", "rounds of growth", 2, int)
    options.named("contrast", "largest contrast of a pixel that joins the mask", 0.5, float)
    options.named("sigma", "width of the point spread function", 1.5, float)
    options.parse(args)
    spark = spark or SparkSession.builder.appName("mask_cosmics").getOrCreate()
    image = read_fits(spark, options["image"], options["hdu"], "double")
    psf, shape = gaussian_psf(2, options["sigma"])
    mask = mask_cosmics(image, psf, shape, options["pfa"], options["quotient"], options["rounds"], options["contrast"])
    if options["output"] == "-":
        write_fits(mask, options["image"], "a", "uint8")
    else:
        write_fits(mask, options["output"], "x", "uint8")


if __name__ == "__main__":
    main(sys.argv[1:])
