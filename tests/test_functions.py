"""Pixel functions at edge values, statistics, noise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import maths, noise
from voxelframe.operators import statistics as stats
from voxelframe.plans.raster import Raster

EDGE = [-math.inf, -1e10, -2.5, -1.0, -0.5, -0.0, 0.0, 0.5, 1.0, 2.5, 1e10, math.inf, math.nan]


def c_round(v):
    return v if not math.isfinite(v) else math.copysign(math.floor(abs(v) + 0.5), v)


REFERENCE = {
    "abs": np.abs, "ceil": np.ceil, "floor": np.floor, "trunc": np.trunc, "cos": np.cos, "sin": np.sin, "tan": np.tan, "acos": np.arccos, "asin": np.arcsin, "atan": np.arctan,
    "cosh": np.cosh, "sinh": np.sinh, "tanh": np.tanh, "acosh": np.arccosh, "asinh": np.arcsinh, "atanh": np.arctanh, "exp": np.exp, "exp2": np.exp2, "expm1": np.expm1,
    "log": np.log, "log2": np.log2, "log10": np.log10, "log1p": np.log1p, "sqrt": np.sqrt, "cbrt": np.cbrt, "round": np.vectorize(c_round), "negate": np.negative,
    "erf": np.vectorize(math.erf), "erfc": np.vectorize(math.erfc),
}


def test_unary_at_the_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in EDGE], "x double")
    got = df.select(*(maths.UNARY[k](F.col("x")).cast("double").alias(k) for k in REFERENCE)).toPandas()
    with np.errstate(all="ignore"):
        for name, f in REFERENCE.items():
            if name in ("cos", "sin", "tan"):
                keep = [abs(v) < 1e9 or not math.isfinite(v) for v in EDGE]
            else:
                keep = [True] * len(EDGE)
            want = f(np.array(EDGE))
            assert np.allclose(got[name][keep], want[keep], rtol=1e-12, equal_nan=True), name


def test_gamma_logb(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 5.0, -0.5, -1.0, 0.0, 200.0, 8.0, 7.9, math.inf)], "x double")
    rows = df.select("x", maths.tgamma(F.col("x")).alias("g"), maths.lgamma(F.col("x")).alias("l"), maths.logb(F.col("x")).alias("e"), maths.ilogb(F.col("x")).alias("i")).collect()
    by = {r["x"]: r for r in rows}
    assert by[5.0]["g"] == 24 and by[200.0]["g"] == math.inf and math.isnan(by[-1.0]["g"]) and by[0.0]["g"] == math.inf
    assert by[-1.0]["l"] == math.inf and by[0.5]["l"] == pytest.approx(math.lgamma(0.5))
    assert (by[8.0]["e"], by[7.9]["e"], by[0.0]["e"], by[math.inf]["e"]) == (3, 2, -math.inf, math.inf)
    assert by[8.0]["i"] == 3 and by[0.0]["i"] is None


def test_binary_at_the_edges(spark):
    pairs = [(a, b) for a in EDGE for b in EDGE]
    df = spark.createDataFrame(pairs, "a double, b double")
    names = ["divide", "fmod", "max", "min", "fdim", "hypot"]
    got = df.select("a", "b", *(maths.BINARY[k](F.col("a"), F.col("b")).alias(k) for k in names)).toPandas()
    a, b = got["a"].to_numpy(), got["b"].to_numpy()
    with np.errstate(all="ignore"):
        want = {"divide": a / b, "fmod": np.fmod(a, b), "max": np.where(a < b, b, a), "min": np.where(b < a, b, a), "hypot": np.hypot(a, b), "fdim": np.where(np.isnan(a) | np.isnan(b), np.nan, np.where(a > b, a - b, 0.0))}
    for name in names:
        assert np.allclose(got[name], want[name], equal_nan=True), name


def test_whole_division(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (-7, -2), (5, 0)], "a long, b long")
    rows = df.select(maths.divide_whole(F.col("a"), F.col("b")).alias("q"), maths.remainder(F.col("a"), F.col("b")).alias("r")).collect()
    assert [tuple(r) for r in rows] == [(3, 1), (-3, -1), (-3, 1), (3, -1), (None, None)]


def test_hsv(spark):
    row = spark.range(1).select(maths.rgb_to_hsv(F.lit(64), F.lit(224), F.lit(208)).alias("c")).first()["c"]
    assert (round(row["h"]), round(row["s"], 3), round(row["v"], 3)) == (174, 0.714, 0.878)


def test_statistics(spark):
    r = Raster.from_values(spark, [2, 1, 9, 4, 1, 2, 6], (7,))
    assert stats.minmax(r) == (1, 9) and stats.median(r) == 2 and stats.mad(r).first()["mad"] == 1
    assert [stats.nth(r, k) for k in range(7)] == [1, 1, 2, 2, 4, 6, 9]
    assert stats.total(r, 1) == 26 and stats.product(r, 2) == 1728 and stats.mean(r) == pytest.approx(25 / 7)
    assert stats.contains(r, 9) and not stats.contains(r, 5) and not stats.contains_only(r, 1) and not stats.contains_nan(r)
    assert stats.norm(r, 0) == 7 and stats.norm(r, 2) == sum(x * x for x in (2, 1, 9, 4, 1, 2, 6)) and stats.distance(r, r.reverse(), 1) == 2 * (4 + 1 + 8)
    ten = Raster.range(spark, (10,))
    rows = stats.histogram(ten, [-10, -0.5, 0, 1.5, 4, 9, 12]).orderBy("bin").collect()
    assert [x["n"] for x in rows] == [0, 0, 2, 2, 5, 1]
    gaps = Raster.from_values(spark, [1.0, math.nan, 3.0], (3,))
    assert stats.contains_nan(gaps) and stats.minmax(gaps) == (1.0, 3.0)
    empty = Raster(ten.df.where("false"), (10,))
    assert not stats.contains_only(empty, 1)


def test_noise_depends_on_seed_and_place_only(spark):
    base = Raster.filled(spark, (40, 50), 100.0)
    for made in (noise.UniformNoise(-1, 1, seed=3), noise.GaussianNoise(0, 2, seed=3), noise.PoissonNoise(seed=3), noise.ImpulseNoise({0: 0.1, 255: 0.1}, seed=3)):
        one = noise.apply_noise(base, made).to_numpy()
        other = noise.apply_noise(Raster(base.df.repartition(5, "x1"), base.shape), made).to_numpy()
        assert (one == other).all()
        changed = base.apply(lambda v: F.when((F.col("x0") == 3) & (F.col("x1") == 4), 7.0).otherwise(v))
        moved = noise.apply_noise(changed, made).to_numpy() != one
        assert moved.sum() <= 1
    drawn = noise.draw_noise(base, noise.GaussianNoise(5, 2, seed=1)).to_numpy()
    assert abs(drawn.mean() - 5) < 0.2 and abs(drawn.std() - 2) < 0.2
    drawn = noise.draw_noise(base, noise.UniformNoise(1, 6, whole=True, seed=1)).to_numpy()
    assert set(np.unique(drawn)) == {1, 2, 3, 4, 5, 6}
    drawn = noise.draw_noise(base, noise.PoissonNoise(9, seed=1)).to_numpy()
    assert abs(drawn.mean() - 9) < 0.4 and abs(drawn.var() - 9) < 1.5
    salted = noise.apply_noise(base, noise.ImpulseNoise.salt_and_pepper(0.2, 0.1, 255, seed=2)).to_numpy()
    assert abs((salted == 255).mean() - 0.2) < 0.05 and abs((salted == 0).mean() - 0.1) < 0.04


@pytest.mark.parametrize("mean", [3.0, 10.0, 47.5, 5000.0, 1e9])
def test_poisson_by_rejection(spark, mean):
    """Mean, variance, skew and tails of 40,000 draws; large means take no longer."""
    base = Raster.filled(spark, (200, 200), 0.0)
    drawn = noise.draw_noise(base, noise.RejectionPoissonNoise(mean, seed=11)).to_numpy().ravel()
    z = (drawn - mean) / math.sqrt(mean)
    assert (drawn >= 0).all() and (drawn == np.floor(drawn)).all()
    assert abs(z.mean()) < 0.02 and abs(z.var() - 1) < 0.03 and abs((z**3).mean() - mean**-0.5) < 0.08
    for x, far in ((1.0, 0.16), (2.0, 0.025), (3.0, 0.002)) if mean >= 40 else ():
        assert abs((np.abs(z) > x).mean() / 2 - far) < 0.03
    if mean == 47.5:
        k = np.arange(20, 80)
        want = np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k]))
        got = np.array([(drawn == x).mean() for x in k])
        assert np.abs(got - want).max() < 0.004
    odd = base.df.limit(1).select(*(noise.RejectionPoissonNoise(seed=1).perturb(F.lit(x), F.lit(3)).alias(n) for n, x in (("nan", math.nan), ("low", -1.0), ("inf", math.inf), ("zero", 0.0)))).first()
    assert math.isnan(odd["nan"]) and math.isnan(odd["low"]) and odd["inf"] == math.inf and odd["zero"] == 0


def test_special_functions_stay_in_the_jvm(spark):
    """Within 1e-13 of the C library's, as expressions without a Python worker."""
    rng = np.random.default_rng(12)
    xs = np.concatenate([rng.uniform(-6, 6, 4000), rng.uniform(-170, 171.5, 2000), rng.uniform(-27, 27, 1000), 10.0 ** rng.uniform(-300, 2, 500), -(10.0 ** rng.uniform(-300, 2, 500)), np.arange(-5.0, 30.0), np.arange(1, 25) + 0.5])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    made = df.select("x", *(maths.UNARY[k](F.col("x")).alias(k) for k in ("erf", "erfc", "tgamma", "lgamma")))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.toPandas()

    def close(name, f, keep=None, least=0.0):
        for x, g in zip(got["x"], got[name], strict=True):
            if keep is None or keep(x):
                w = f(x)
                # Powers above a hundred lose a digit.
                most = 3e-13 if name == "tgamma" and abs(x) > 100 else 1e-13
                assert g == w or abs(g - w) <= most * max(abs(w), least), (name, x, g, w)

    smooth = lambda x: x > 0 or abs(x - round(x)) > 1e-9
    close("erf", math.erf)
    close("erfc", math.erfc, lambda x: x < 26)
    close("tgamma", math.gamma, lambda x: smooth(x) and -170 < x < 171 and 1e-300 < abs(x), 1e-290)
    # Near its zeros the logarithm is held to absolute differences.
    close("lgamma", math.lgamma, lambda x: smooth(x) and x != 0, 10.0)
