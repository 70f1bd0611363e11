"""Affine maps, interpolation, spectra, cosmic-ray masks."""

import numpy as np
import pytest

from voxelframe.operators.cosmics import detect, mask_cosmics, segment
from voxelframe.operators.resampling import CUBIC, LINEAR, NEAREST, Affinity, Matrix, downsample, interpolate, scale, translate, upsample, warp
from voxelframe.operators.spectra import DftPlan, complex_dft, derivative, inverse_complex_dft, inverse_real_dft, real_dft
from voxelframe.operators.stencil import Constant, Nearest, Periodic
from voxelframe.plans.errors import SizeError
from voxelframe.plans.raster import Raster


def complex_numpy(raster):
    rows = raster.df.select("*", "v.re", "v.im").toPandas()
    out = np.empty(raster.shape, complex)
    out[tuple(rows[a] for a in raster.axes)] = rows["re"] + 1j * rows["im"]
    return out


def test_interpolation_goldens(spark):
    def value(raster, at, method, how=Nearest()):
        df = spark.createDataFrame([(0, *map(float, at))], "k int, a double, b double, c double")
        return interpolate(raster, df, ["a", "b", "c"], method, how, ["k"]).first()["v"]

    small = Raster.range(spark, (2, 2, 2), 1)
    assert value(small, (0.5, 0.5, 0.5), LINEAR) == 4.5
    assert value(small, (2, 3, 4), NEAREST, Periodic()) == small.at((0, 1, 0))
    assert value(small, (-1.6, -1.6, -1.6), NEAREST, Periodic()) == small.at((1, 1, 1))
    assert value(small, (9, 9, 9), NEAREST, Constant(-3)) == -3
    cubic = Raster.range(spark, (4, 4, 4), 1)
    assert value(cubic, (1.5, 1.5, 1.5), CUBIC) == 32.5


def test_affinity():
    turn = Affinity.rotation(90, 3, 0, 1)
    assert np.allclose(turn((1, 0, 0)), (0, 1, 0))
    assert np.allclose(Affinity.rotation(-90, 3, 1, 2, [1, 1, 1])((1, 2, 1)), (1, 1, 0))
    both = (Affinity.scaling([2, 3], [1, 1]) + [1, -1]).rotate(30)
    assert np.allclose(both.inverse()(both((3, 4))), (3, 4))
    assert np.allclose((Affinity.identity(2) * 2 / 4 - 1)((4, 8)), (1, 3))
    assert np.isclose(Matrix.diagonal([2, 4]).determinant(), 8) and Matrix.diagonal([2, 4]).inverse()[0, 0] == 0.5 and Matrix.identity(2)[0, 1] == 0


def test_warps(spark):
    values = np.random.default_rng(2).normal(size=(6, 8))
    raster = Raster.from_numpy(spark, values)
    moved = translate(raster, [2, 1], LINEAR, Constant(0)).to_numpy()
    assert np.allclose(moved[1:, 2:], values[:-1, :-2]) and not moved[0].any() and not moved[:, :2].any()
    there = warp(raster, Affinity.translation([1, 0]), CUBIC, Periodic())
    assert np.allclose(warp(there, Affinity.translation([-1, 0]), CUBIC, Periodic()).to_numpy(), values)
    assert np.allclose(scale(raster, 1.0, LINEAR).to_numpy(), values)
    up = upsample(raster, 3).to_numpy()
    assert up.shape == (18, 24) and up[17, 23] == values[5, 7]
    assert np.allclose(downsample(upsample(raster, 2, [0]), 2, [0]).to_numpy(), values)


def test_spectra(spark):
    values = np.random.default_rng(3).normal(size=(6, 5, 4))
    raster = Raster.from_numpy(spark, values)
    want = np.fft.fftn(values.T)
    assert np.allclose(complex_numpy(complex_dft(raster)), want)
    half = real_dft(raster)
    assert half.shape == (3, 5, 6) and np.allclose(complex_numpy(half), want[:3])
    assert np.allclose(inverse_real_dft(half, raster.shape).to_numpy(), values)
    assert np.allclose(complex_numpy(inverse_complex_dft(complex_dft(raster))), values.T)
    plan = DftPlan(raster.shape)
    assert np.allclose(plan.inverse(plan.transform(raster), normalize=False).to_numpy(), values * plan.normalization_factor)
    odd = Raster.from_numpy(spark, values[0, 0][:3])
    assert np.allclose(inverse_real_dft(real_dft(odd), odd.shape).to_numpy(), values[0, 0][:3])
    wave = Raster.from_numpy(spark, np.sin(np.radians(np.arange(360))))
    assert np.allclose(derivative(wave, 0, 2 * np.pi).to_numpy(), np.cos(np.radians(np.arange(360))), atol=1e-9)


def test_cosmics(spark):
    rng = np.random.default_rng(4)
    sky = rng.normal(100, 1, (24, 24))
    sky[10, 12] += 500
    sky[10, 13] += 400
    image = Raster.from_numpy(spark, sky)
    psf = np.exp(-((np.indices((5, 5)) - 2) ** 2).sum(axis=0) / 4).ravel()
    mask = detect(image, psf, (5, 5), 1e-4, 0.9)
    found = set(zip(*np.nonzero(mask.to_numpy())))
    assert (10, 12) in found and len(found) <= 4
    seed = image.apply(lambda v: (v > 550).cast("int"))
    grown = segment(image, seed, 0.3).to_numpy()
    assert grown[10, 13] == 1 and grown.sum() == 2
    assert mask_cosmics(image, psf, (5, 5), 1e-4, 0.9, rounds=1, threshold=0.3).to_numpy()[10, 12] == 1
    with pytest.raises(SizeError):
        detect(image, psf[:3], (5, 5))


def test_long_lines_take_few_shuffles(spark):
    """One for each factor, and two convolution steps of five and fifteen values for a prime one."""
    for n, line, most in ((500, 16, 3), (16 * 37, 16, 5), (97, 8, 6)):
        values = np.random.default_rng(n).normal(size=(n, 3))
        spectrum = real_dft(Raster.from_numpy(spark, values), axes=[1], line=line)
        plan = spectrum.df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most
        got = np.full((3, n // 2 + 1), np.nan, complex)
        for r in spectrum.df.collect():
            got[r["x0"], r["x1"]] = complex(r["v"]["re"], r["v"]["im"])
        assert np.abs(got - np.fft.rfft(values.T)).max() < 1e-9
