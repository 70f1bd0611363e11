"""Chunk form against NumPy and pixel form, missing pixels, selection by digits."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import statistics as stats
from voxelframe.operators.chunk_warp import resample_chunks, warp_chunks
from voxelframe.operators.resampling import CUBIC, LINEAR, NEAREST, Affinity, resample, warp
from voxelframe.operators.stencil import Constant, Convolution, Mean, Nearest, Periodic, apply_filter, gather
from voxelframe.plans.raster import Raster
from voxelframe.plans.regions import Box
from voxelframe.streaming.chunks import combine_chunks, filter_chunks, to_chunks, to_pixels

MAPS = {
    "moved": Affinity.translation([3.25, -2.5]),
    "turned": Affinity.rotation(33, 2, center=[15, 11]),
    "scaled": Affinity.scaling([0.3, 2.2], [15, 11]) + [4, -60],
    "far": Affinity.translation([100, 0]),
}


def kept(df):
    """Rows that stand, in place of the plan that makes them."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def raster(spark):
    made = Raster.from_numpy(spark, np.random.default_rng(1).normal(size=(23, 31)))
    return Raster(kept(made.df), made.shape)


@pytest.fixture(scope="module")
def chunks(raster):
    return kept(to_chunks(raster, (8, 5)))


@pytest.mark.parametrize(("name", "method", "how"), [(n, m, h) for (n, m), h in zip(itertools.product(MAPS, (NEAREST, LINEAR, CUBIC)), itertools.cycle((Nearest(), Constant(2.5), Periodic(), Constant(-1), Nearest())))])
def test_warps_like_pixels(raster, chunks, name, method, how):
    want = warp(raster, MAPS[name], method, how).to_numpy()
    got = Raster(to_pixels(warp_chunks(chunks, MAPS[name], raster.shape, (8, 5), method, how), 2), raster.shape).to_numpy()
    assert np.allclose(got, want, atol=1e-9)


def test_warp_sends_about_the_raster_once(spark, raster, chunks):
    """Pieces sent for a move by half a pixel are little more than the raster."""
    from voxelframe.operators import chunk_warp

    seen = []
    real = chunk_warp.exchange

    def count(chunks_, shape, tile, send, make, kind, origin=()):
        for r in chunks_.collect():
            own = Box(tuple(r["front"]), tuple(f + s - 1 for f, s in zip(r["front"], r["shape"], strict=True)))
            seen.extend(part.size for _, part, _ in send(own))
        return real(chunks_, shape, tile, send, make, kind, origin)

    chunk_warp.exchange = count
    try:
        warp_chunks(chunks, Affinity.translation([0.5, 0.5]), raster.shape, (8, 5))
    finally:
        chunk_warp.exchange = real
    assert raster.size < sum(seen) < 1.6 * raster.size


def test_three_axes_and_shrinking(spark):
    values = np.random.default_rng(4).normal(size=(9, 11, 13))
    raster = Raster(kept(Raster.from_numpy(spark, values).df), (13, 11, 9))
    chunks = kept(to_chunks(raster, (5, 4, 3)))
    turn = Affinity.rotation(20, 3, 0, 2, [6, 5, 4]) * 0.4
    got = warp_chunks(chunks, turn, raster.shape, (5, 4, 3), LINEAR, Constant(0))
    assert got.count() > 27  # smaller tiles, as their preimages would be large
    assert np.allclose(Raster(to_pixels(got, 3), raster.shape).to_numpy(), warp(raster, turn, LINEAR, Constant(0)).to_numpy())
    for f in ((2, 1, 1.5), (0.5, 0.4, 1)):
        shape = tuple(int(a * b) for a, b in zip(raster.shape, f, strict=True))
        assert (Raster(to_pixels(resample_chunks(chunks, f, raster.shape, (5, 4, 3)), 3), shape).to_numpy() == resample(raster, f).to_numpy()).all()


# -- missing pixels


def test_holes_in_pixel_rows(spark):
    ones = Raster.filled(spark, (6, 5), 1.0)
    holed = Raster(ones.df.where("NOT (x0 = 2 AND x1 = 2)"), ones.shape)
    got = warp(holed, Affinity.translation([0.5, 0.5])).to_numpy()
    assert np.isnan(got).sum() == 4 and np.nansum(got) == 26
    got = warp(holed, Affinity.translation([0.5, 0.5]), LINEAR, Constant(1.0)).to_numpy()
    assert np.isnan(got).sum() == 4 and np.nansum(got) == 26
    both = ones.apply(lambda a, b: a + b, holed)
    assert both.df.count() == 30 and both.df.where(F.isnan("v")).count() == 1
    assert holed.apply(lambda a, b: a + b, ones).df.where(F.isnan("v")).count() == 1
    whole = Raster(holed.df.withColumn("v", F.col("v").cast("long")), ones.shape)
    with pytest.raises(Exception, match="lacks a position"):
        whole.apply(lambda a, b: a + b, whole.apply(lambda v: v).reverse()).df.collect()
    for how in (Nearest(), Constant(7.0)):
        assert np.isnan(apply_filter(Mean(Box((-1, -1), (1, 1))), holed, how).to_numpy()).sum() == 9
        at = gather(Convolution([1.0] * 9, Box((-1, -1), (1, 1))), holed, ones.df.select("x0", "x1"), how)
        assert at.where(F.isnan("v")).count() == 9


def test_holes_in_chunks(spark, raster, chunks):
    holed = chunks.where("front[0] <> 8 OR front[1] <> 5")
    for how in (Nearest(), Constant(5.0), Periodic()):
        got = Raster(to_pixels(filter_chunks(holed, Mean(Box((-1, -1), (1, 1))), raster.shape, (8, 5), how), 2), raster.shape).to_numpy()
        want = apply_filter(Mean(Box((-1, -1), (1, 1))), raster, how).to_numpy()
        gone = np.zeros(got.shape, bool)
        gone[4:11, 7:17] = True
        assert np.isnan(got[gone]).all() and np.allclose(got[~gone], want[~gone])
    # A chunk whose neighbours are missing too is still there.
    one = chunks.where("front[0] = 0 AND front[1] = 0")
    assert filter_chunks(one, Mean(Box((0, 0), (0, 0))), raster.shape, (8, 5)).count() == chunks.count()
    for a, b in ((chunks, holed), (holed, chunks)):
        sums = Raster(to_pixels(combine_chunks(a, b, lambda x, y: x + y), 2), raster.shape)
        assert sums.df.count() == raster.size and np.isnan(sums.to_numpy()).sum() == 40
    whole = to_chunks(raster.apply(lambda v: F.round(v * 100).cast("long")), (8, 5), "bigint")
    with pytest.raises(Exception, match="no NaN"):
        combine_chunks(whole, whole.where("front[0] = 0"), lambda x, y: x + y).collect()
    with pytest.raises(Exception, match="tile lacks pixels"):
        to_chunks(Raster(raster.df.where("x0 <> 3"), raster.shape), (8, 5)).collect()


# -- selection


@pytest.mark.parametrize("digits", [14, 3])
def test_selection(spark, monkeypatch, digits):
    monkeypatch.setattr(stats, "DIGITS", digits)
    rng = np.random.default_rng(5)
    odd = [math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.0000000000000002, 0.9999999999999999, 2.0, 3.9999999999999996, 4.0]
    values = np.concatenate([odd, rng.normal(size=200), 2.0 ** rng.integers(-1074, 1023, 200), np.nextafter(2.0 ** rng.integers(-1000, 1000, 100), 0), np.full(60, 0.25)])
    raster = Raster.from_values(spark, values.tolist(), (len(values),))
    ordered = np.sort(values)
    ranks = sorted({0, 1, 2, len(values) - 1, len(values) - 2, *rng.integers(0, len(values), 25).tolist()})
    size, found = stats.select(raster.df, F.col("v"), lambda n: ranks)
    assert size == len(values)
    assert np.array_equal([found[r] for r in ranks], ordered[ranks], equal_nan=True)
    whole = rng.integers(-(2**63), 2**63 - 1, 300).tolist() + [2**63 - 1, -(2**63), 2**60, 2**60 + 1, 0]
    big = Raster.from_values(spark, whole, (len(whole),))
    _, found = stats.select(big.df, F.col("v"), lambda n: range(0, n, 7))
    assert all(found[k] == sorted(whole)[k] for k in range(0, len(whole), 7))


def test_order_key_is_the_doubles_bits(spark):
    rng = np.random.default_rng(8)
    values = rng.integers(0, 2047 << 52, 3000).view(np.float64)
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select(stats.order_key(F.col("v"), spark.range(1).select(F.lit(1.0)).schema[0].dataType).alias("k"))
    assert [r["k"] for r in got.collect()] == values.view(np.int64).tolist()


def test_quantiles_plan_nothing_sorted(spark):
    values = np.random.default_rng(6).normal(size=5000)
    raster = Raster.from_values(spark, values.tolist(), (5000,))
    assert np.allclose(stats.quantiles(raster, [0, 0.1, 0.5, 0.97, 1]), np.quantile(values, [0, 0.1, 0.5, 0.97, 1]))
    row = stats.mad(raster).first()
    assert np.isclose(row["mad"], np.median(np.abs(values - np.median(values))))
    empty = Raster(raster.df.where("x0 < 0"), (5000,))
    assert stats.quantiles(empty, [0.5]) == [None]
    with pytest.raises(IndexError):
        stats.nth(empty, 0)
