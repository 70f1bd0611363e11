"""Masks of cosmic-ray hits in images."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.maths import is_nan
from ..plans.raster import Raster, pixel
from ..plans.regions import Box
from ..plans.scratch import scratch_path
from .stencil import Correlation, Dilation, Mean, Nearest, apply_filter, centred, pearson, quotient

#: The 3 by 3 second-difference kernel.
KERNEL = (-1 / 6, -2 / 3, -1 / 6, -2 / 3, 10 / 3, -2 / 3, -1 / 6, -2 / 3, -1 / 6)
LARGEST = 1.7976931348623157e308


def laplacian(image: Raster) -> Raster:
    return apply_filter(Correlation(KERNEL, Box((-1, -1), (1, 1))), image, Nearest())


def template_quotient(image: Raster, psf: Sequence[float], shape: Sequence[int]) -> Raster:
    return apply_filter(quotient(psf, centred(shape)), image, Nearest())


def template_match(image: Raster, psf: Sequence[float], shape: Sequence[int]) -> Raster:
    return apply_filter(pearson(psf, centred(shape)), image, Nearest())


def dilate(image: Raster, radius: int = 1) -> Raster:
    return apply_filter(Dilation(Box.from_center(radius, (0,) * image.dimension)), image, Nearest())


def blur(image: Raster, radius: int = 1) -> Raster:
    return apply_filter(Mean(Box.from_center(radius, (0,) * image.dimension)), image, Nearest())


def detect(image: Raster, psf: Sequence[float], psf_shape: Sequence[int], false_alarms: float = 0.01, most_quotient: float = 0.5) -> Raster:
    """1 where the Laplacian stands out and the surroundings don't look like the point spread function, else 0.

    The threshold is -mean|L| * ln(2 * false_alarms), over the values of L that aren't NaN.
    """
    edges = laplacian(image)
    strength = edges.df.where(~is_nan(pixel())).agg((-F.avg(F.abs(pixel())) * math.log(2 * false_alarms)).alias("_t"))
    likeness = dilate(template_quotient(image, psf, psf_shape))
    both = edges.df.join(likeness.df.withColumnRenamed("v", "_q"), edges.axes).crossJoin(F.broadcast(strength))  # one row
    hit = (pixel() > F.col("_t")) & (F.col("_q") < most_quotient) & ~is_nan(pixel()) & ~is_nan(F.col("_q"))
    return Raster(both.select(*edges.axes, hit.cast("int").alias("v")), image.shape, image.front)


def min_contrast(image: Raster, mask: Raster) -> Raster:
    """Least (n - p) / n over the neighbours n of pixel p that the mask flags; the largest number where there are none."""
    cross = [tuple(d if j == k else 0 for j in range(image.dimension)) for k in range(image.dimension) for d in (-1, 1)]
    flagged = image.df.join(mask.df.where("v != 0").select(*image.axes), image.axes, "left_semi")
    offsets = F.array(*(F.struct(*(F.lit(d).alias(a) for d, a in zip(o, image.axes, strict=True))) for o in cross))
    around = flagged.withColumn("_o", F.explode(offsets)).select(*((F.col(a) + F.col(f"_o.{a}")).alias(a) for a in image.axes), F.col("v").alias("_n"))
    contrast = F.min((F.col("_n") - F.col("v")) / F.nullif(F.col("_n"), F.lit(0.0)))
    found = image.df.join(around, image.axes).groupBy(*image.axes).agg(contrast.alias("_c"))
    return Raster(image.df.join(found, image.axes, "left").select(*image.axes, F.coalesce("_c", F.lit(LARGEST)).alias("v")), image.shape, image.front)


def segment(image: Raster, mask: Raster, threshold: float) -> Raster:
    """Grow the mask by one round: neighbours of flagged pixels, within a margin of one, whose contrast is below ``threshold``.

    All pixels of a round are judged by the mask as it was before it, so the result doesn't depend on any order.
    """
    inner = image.domain.shrink(Box.from_center(1, (0,) * image.dimension))
    new = min_contrast(image, mask).df.where(inner.predicate() & (pixel() < threshold)).select(*image.axes, F.lit(1).alias("_g"))
    grown = mask.df.join(new, image.axes, "left")
    return Raster(grown.select(*image.axes, F.when((pixel() != 0) | (F.col("_g") == 1), 1).otherwise(0).alias("v")), mask.shape, mask.front)


def mask_cosmics(image: Raster, psf: Sequence[float], psf_shape: Sequence[int], false_alarms: float = 0.01, most_quotient: float = 0.5, rounds: int = 2, threshold: float = 0.5) -> Raster:
    """Detection and ``rounds`` of growth. Each round's mask is written, as the next one reads it twice."""
    mask = detect(image, psf, psf_shape, false_alarms, most_quotient)
    for _ in range(rounds):
        path = scratch_path(image.df.sparkSession, "mask")
        mask.df.write.parquet(path)
        mask = segment(image, replace(mask, df=image.df.sparkSession.read.parquet(path)), threshold)
    return mask


