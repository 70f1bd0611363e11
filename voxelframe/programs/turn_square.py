"""Draw a square, turn and scale it, and write both images to a FITS file."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.resampling import CUBIC, Affinity, center_of, warp
from ..operators.stencil import Constant
from ..plans.raster import Raster
from ..plans.regions import Box
from ..plans.steps import Options
from ..sources.fits import write_fits


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    options = Options("Turn and scale a square.")
    options.positional("output", "FITS file to write")
    options.named("side", "pixels of the image along an axis", 64, int)
    options.named("angle", "degrees", 30.0, float)
    options.named("scale", "factor", 1.5, float)
    options.parse(args)
    spark = spark or SparkSession.builder.appName("turn_square").getOrCreate()
    side = options["side"]
    square = Box((side // 4, side // 4), (3 * side // 4, 3 * side // 4))
    image = Raster.filled(spark, (side, side), 0.0).generate(lambda *x: F.when(square.predicate(list(x)), 1.0).otherwise(0.0))
    moved = warp(image, Affinity.rotation(options["angle"], 2, center=center_of(image)) * options["scale"], CUBIC, Constant(0))
    write_fits(image, options["output"], "x", "float32")
    write_fits(moved, options["output"], "a", "float32")


if __name__ == "__main__":
    main(sys.argv[1:])
