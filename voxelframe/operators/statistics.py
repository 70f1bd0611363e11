"""Reductions and order statistics of rasters, each one aggregate over the executors."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from ..functions.maths import abspow, is_nan
from ..plans.raster import Raster, pixel
from ..plans.scratch import scratch_path

#: Bits by which a pass of selection tells values apart.
DIGITS = 14

def summary(raster: Raster, value: Column | None = None) -> DataFrame:
    """One row: n, min, max, sum, mean, variance and stdev (of a sample and of a population)."""
    value = pixel() if value is None else value
    x = value.cast("double")
    return raster.df.agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(x).alias("sum"), F.avg(x).alias("mean"),
        F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("stdev"), F.var_pop(x).alias("variance_pop"), F.stddev_pop(x).alias("stdev_pop"),
    )


def total(raster: Raster, offset: float = 0.0) -> float:
    return raster.df.agg(F.coalesce(F.sum(pixel().cast("double")), F.lit(0.0))).first()[0] + offset


def product(raster: Raster, factor: float = 1.0) -> float:
    row = raster.df.agg(F.product(pixel().cast("double"))).first()[0]
    return (1.0 if row is None else row) * factor


def mean(raster: Raster) -> float:
    return raster.df.agg(F.avg(pixel().cast("double"))).first()[0]


def minmax(raster: Raster) -> tuple[object, object]:
    """Least and largest value; NaN is passed over, unlike by Spark's max."""
    kept = F.when(~is_nan(pixel()), pixel())
    return tuple(raster.df.agg(F.min(kept), F.max(kept)).first())


def contains(raster: Raster, value: float) -> bool:
    return bool(raster.df.where((pixel() == value) & ~is_nan(pixel())).limit(1).count())


def contains_only(raster: Raster, value: float) -> bool:
    """False for an empty raster."""
    n, hits = raster.df.agg(F.count(F.lit(1)), F.count(F.when((pixel() == value) & ~is_nan(pixel()), 1))).first()
    return n > 0 and n == hits


def contains_nan(raster: Raster) -> bool:
    return bool(raster.df.where(is_nan(pixel())).limit(1).count())


def ranked(raster: Raster, value: Column | None = None) -> DataFrame:
    """(value, first, last): the ranks, counted from 0, that each distinct value takes in ascending order; NaN comes last.

    Equal values are counted before any shuffle, values are dealt out by range and numbered within their ranges, so no
    task holds more than its range; only one number per range is added up in one place.
    """
    counted = raster.df.groupBy((pixel() if value is None else value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(raster.df.sparkSession, "ranked")
    counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()).write.parquet(path)
    held = raster.df.sparkSession.read.parquet(path)
    parts = held.groupBy("part").agg(F.sum("n").alias("size"))
    starts = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    placed = held.join(F.broadcast(starts), "part")  # a row for each range
    last = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("value")) - 1
    return placed.select("value", (last - F.col("n") + 1).alias("first"), last.alias("last"))


# -- selection by digits


def order_key(value: Column, kind: DataType) -> Column:
    """A 64-bit whole number that orders as ``value`` does: itself if it is whole, else the bits of the double, NaN last.

    The bits are put together from exponent and fraction, all of it exact: scaling by powers of two loses nothing, and
    an exponent that the logarithm rounds wrongly is set right by looking at the fraction.
    """
    if isinstance(kind, IntegralType):
        return value.cast("long")
    x = value.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    part = size * F.pow(F.lit(2.0), -guess)
    exponent = guess + F.when(part < 1, -1).when(part >= 2, 1).otherwise(0)
    fraction = F.when(part < 1, part * 2).when(part >= 2, part / 2).otherwise(part)
    normal = (exponent + 1023).cast("long") * (1 << 52) + ((fraction - 1) * float(1 << 52)).cast("long")
    # Numbers below the least normal one are whole multiples of 2 ** -1074.
    bits = F.when(size < 2.0**-1022, (size * 2.0**537 * 2.0**537).cast("long")).when(size == math.inf, F.lit(2047 << 52)).otherwise(normal)
    return F.when(F.isnan(x), F.lit((2047 << 52) + 1)).when(x < 0, -bits).otherwise(bits)


def key_value(key: int, kind: DataType) -> int | float:
    """The value of an ``order_key``."""
    if isinstance(kind, IntegralType):
        return key
    if abs(key) > 2047 << 52:
        return math.nan
    found = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -found if key < 0 else found


def select(df: DataFrame, value: Column, ranks: Callable[[int], Sequence[int]]) -> tuple[int, dict[int, int | float]]:
    """The number of values, and those of the asked ranks (counted from 0 in ascending order), which ``ranks`` tells for a number.

    Values are counted by the leading digits of their ``order_key``; then only the stretches that hold an asked rank are
    counted by their next digits. Counts are combined before the shuffle and a pass brings at most 2 ** DIGITS of them
    for each rank. Nothing is sorted or written; two passes do for a billion values, five for any.
    """
    kind = df.select(value.alias("v")).schema["v"].dataType
    key = order_key(value, kind)
    # Made once a row: a plain projection would be written out again wherever the key is compared.
    keys = df.select(F.explode(F.array(key)).alias("k")).where(F.col("k").isNotNull())
    # (least key, greatest key, shift) of stretches that hold asked ranks, and by stretch the ranks within it.
    stretches: list[tuple[int, int, int]] = [(-(1 << 63), (1 << 63) - 1, 64 - DIGITS)]
    wanted: list[list[tuple[int, int]]] | None = None
    size, found = 0, {}
    while stretches:
        which, digit = F.lit(None).cast("int"), F.lit(None).cast("long")
        for number, (low, high, shift) in enumerate(stretches):
            inside = F.col("k").between(low, high)
            which, digit = F.when(inside, number).otherwise(which), F.when(inside, F.shiftright("k", shift)).otherwise(digit)
        counted = keys.select("k", which.alias("s"), digit.alias("d")).where("s IS NOT NULL").groupBy("s", "d").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
        got = sorted(zip(*(c.to_pylist() for c in counted.select("s", "low", "high", "n").toArrow().columns), strict=True))
        if wanted is None:
            size = sum(x[3] for x in got)
            wanted = [[(r, r) for r in sorted(set(ranks(size)))]]
        deeper, left = {}, [list(w) for w in wanted]
        before = [0] * len(stretches)
        for s, low, high, n in got:
            for rank, within in left[s]:
                if before[s] <= within < before[s] + n:
                    if low == high:
                        found[rank] = key_value(low, kind)
                    else:
                        deeper.setdefault((low, high, n), []).append((rank, within - before[s]))
            before[s] += n
        # Few values are told apart by their whole keys, many by the digits after those that are the same in all.
        stretches = [(low, high, 0 if n <= 1 << DIGITS else max(0, (low ^ high).bit_length() - DIGITS) if (low < 0) == (high < 0) else 64 - DIGITS) for low, high, n in deeper]
        wanted = list(deeper.values())
    return size, found


def quantile_row(raster: Raster, qs: dict[str, float], value: Column | None = None) -> DataFrame:
    """One row with exact quantiles by name, interpolated linearly between neighbours; null for an empty raster. NaN comes last."""
    sides = lambda n, q: (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))
    size, found = select(raster.df, pixel() if value is None else value, lambda n: [r for q in qs.values() for r in sides(n, float(q))] if n else [])
    row = []
    for q in map(float, qs.values()):
        if not size:
            row.append(None)
            continue
        low, high = (float(found[r]) for r in sides(size, q))
        at = q * (size - 1)
        row.append(low if low == high else low + (high - low) * (at - math.floor(at)))
    return raster.df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{n}` double" for n in qs))


def quantiles(raster: Raster, qs: Sequence[float]) -> list[float]:
    """Exact quantiles, interpolated linearly between neighbours."""
    return list(quantile_row(raster, {f"q{k}": q for k, q in enumerate(qs)}).first())


def median(raster: Raster) -> float:
    return quantiles(raster, [0.5])[0]


def nth(raster: Raster, n: int) -> object:
    """The n-th smallest value, counted from 0, in its own type."""
    size, found = select(raster.df, pixel(), lambda size: [n] if 0 <= n < size else [])
    if not found:
        raise IndexError(f"{n} not in [0, {size - 1}]")
    return found[n]


def mad(raster: Raster) -> DataFrame:
    """One row: the median and the median of the absolute deviations from it."""
    middle = median(raster)
    away = quantile_row(raster, {"mad": 0.5}, F.abs(pixel() - F.lit(middle)))
    return away.select(F.lit(middle).cast("double").alias("median"), "mad")


def histogram(raster: Raster, edges: Sequence[float]) -> DataFrame:
    """(bin, low, high, n) for every bin: low included, high excluded but for the last; values outside are dropped.

    The bin is found by bisection over a literal array, so a row costs the logarithm of the number of bins.
    """
    edges = [float(e) for e in edges]
    if len(edges) < 2 or edges != sorted(edges):
        raise ValueError("two edges or more, ascending")

    def find(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(pixel() >= edges[mid], find(mid, hi)).otherwise(find(lo, mid))

    inside = raster.df.where((pixel() >= edges[0]) & (pixel() <= edges[-1]) & ~is_nan(pixel()))
    counted = inside.groupBy(find(0, len(edges) - 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = raster.df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    return bins.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def norm(raster: Raster, p: int = 2) -> float:
    """The sum of |v| ** p, not rooted; for p = 0 the number of values other than 0."""
    return raster.df.agg(F.sum(abspow(pixel(), p))).first()[0]


def distance(a: Raster, b: Raster, p: int = 2) -> float:
    """The norm of the difference."""
    return norm(a.apply(lambda u, v: u - v, b), p)


def reduce_tiles(raster: Raster, tile: Sequence[int]) -> DataFrame:
    """n, sum, min and max of every tile, combined before the shuffle."""
    keys = [f"t{k}" for k in range(raster.dimension)]
    return raster.tiled(tile).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"))
