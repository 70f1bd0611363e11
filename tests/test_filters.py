"""Filters against plain loops, and properties that must hold between ways of computing the same."""

import numpy as np
import pytest

from voxelframe.operators.stencil import (
    Aggregate,
    BinaryErosion,
    Constant,
    Convolution,
    Correlation,
    Custom,
    Dilation,
    Erosion,
    Mean,
    Median,
    Nearest,
    Periodic,
    apply_filter,
    along,
    centred,
    gather,
    impulse_response,
    laplace,
    pad,
    pearson,
    prewitt,
    quotient,
    scharr,
    sobel,
)
from voxelframe.plans.errors import SizeError
from voxelframe.streaming.chunks import combine_chunks, filled_chunks, filter_chunks, to_pixels
from voxelframe.plans.raster import Raster
from voxelframe.plans.regions import Box, Grid, Mask


def plain(array, window, how, function):
    """``array`` has axes in raster order."""
    out = np.empty(array.shape)
    for p in np.ndindex(array.shape):
        seen = []
        for w in window:
            q = [a + b for a, b in zip(p, w)]
            if isinstance(how, Nearest):
                q = [min(max(x, 0), n - 1) for x, n in zip(q, array.shape)]
            elif isinstance(how, Periodic):
                q = [x % n for x, n in zip(q, array.shape)]
            inside = all(0 <= x < n for x, n in zip(q, array.shape))
            seen.append(array[tuple(q)] if inside else how.value)
        out[p] = function(np.array(seen, float))
    return out


@pytest.fixture(scope="module")
def image(spark):
    values = np.random.default_rng(1).integers(0, 50, (7, 9)).astype(float)
    return Raster.from_numpy(spark, values), values.T


WINDOW = Box((-1, -2), (2, 1))
CASES = {
    "correlation": (Correlation(list(range(16)), WINDOW), lambda n: (np.arange(16) * n).sum()),
    "convolution": (Convolution(list(range(16)), WINDOW), lambda n: (np.arange(16)[::-1] * n).sum()),
    "mean": (Mean(WINDOW), np.mean),
    "median": (Median(WINDOW), np.median),
    "erosion": (Erosion(WINDOW), np.min),
    "dilation": (Dilation(Mask.ball(2, (0, 0), 1)), np.max),
    "far": (Mean(Box((3, 4), (4, 4))), np.mean),
    "custom": (Custom(WINDOW, lambda n: np.ptp(n, axis=0)), np.ptp),
}


@pytest.mark.parametrize("how", [Constant(3), Nearest(), Periodic()], ids=["constant", "nearest", "periodic"])
@pytest.mark.parametrize("name", sorted(CASES))
def test_against_loops(image, name, how):
    f, function = CASES[name]
    raster, values = image
    got = apply_filter(f, raster, how, tile=(4, 3)).to_numpy().T
    assert np.allclose(got, plain(values, f.window, how, function))


def test_window_larger_than_the_raster(spark):
    raster = Raster.range(spark, (3, 2))
    window = Box((-4, -5), (4, 5))
    got = apply_filter(Mean(window), raster, Periodic(), tile=(2, 1)).to_numpy().T
    assert np.allclose(got, plain(np.arange(6).reshape(2, 3).T.astype(float), window, Periodic(), np.mean))


def test_crop_region_decimation_and_tiles(image):
    raster, _ = image
    f = Convolution(list(range(16)), WINDOW)
    whole = apply_filter(f, raster, Nearest()).to_numpy().T
    cropped = apply_filter(f, raster).to_numpy().T
    assert (cropped == whole[1:-2, 2:-1]).all()
    grid = Grid((1, 0), (8, 6), (3, 2))
    assert (apply_filter(f, raster, Nearest(), grid, tile=(2, 2)).to_numpy().T == whole[1:9:3, 0:7:2]).all()
    assert (apply_filter(f, raster, Nearest(), Box((2, 1), (5, 3))).to_numpy().T == whole[2:6, 1:4]).all()
    assert (apply_filter(f, raster, Nearest(), tile=(2, 3)).to_numpy().T == whole).all()
    at = raster.df.select("x0", "x1")
    rows = gather(f, raster, at).collect()
    assert all(whole[r["x0"], r["x1"]] == r["v"] for r in rows)
    with pytest.raises(SizeError):
        apply_filter(f, raster, None, Box((0, 0), (5, 3)))


def test_compositions(image):
    raster, values = image
    a, b = Mean(Box((-1, 0), (1, 0))), Dilation(Box((0, -1), (0, 1)))
    both = apply_filter(a * b, raster, Constant(0), tile=(3, 4)).to_numpy().T
    padded = np.pad(values, 2)
    mean = (padded[:-2] + padded[1:-1] + padded[2:]) / 3
    want = np.maximum(np.maximum(mean[:, :-2], mean[:, 1:-1]), mean[:, 2:])[1:-1, 1:-1]
    assert np.allclose(both, want)
    k, m = Correlation([1, 2, 1], Box((-1, 0), (1, 0))), Correlation([1, -1], Box((0, 0), (0, 1)))
    one, two = (apply_filter(f, raster).to_numpy() for f in (k * m, m * k))
    assert np.allclose(one, two)
    total = apply_filter(k + m, raster).to_numpy()
    want = apply_filter(Aggregate(lambda x, y: x + y, [k, m]), raster).to_numpy()
    assert (total == want).all()


def test_golden_small(spark):
    ones = Raster.filled(spark, (4, 3), 1)
    box = Box((-1, -1), (1, 1))
    flat = lambda f: apply_filter(f, ones, Constant(0)).to_numpy().ravel().astype(int).tolist()
    want = lambda f: plain(np.ones((4, 3)), box, Constant(0), f).T.ravel().astype(int).tolist()
    assert flat(Median(box)) == want(np.median)
    assert flat(Erosion(box)) == flat(BinaryErosion(box)) == want(np.min)
    assert flat(Dilation(box)) == want(np.max)
    assert flat(Convolution([1] * 9, centred((3, 3)))) == want(np.sum)


@pytest.mark.parametrize("sign", [1, -1])
def test_impulse_kernels(sign):
    for maker, k in ((prewitt, (1, 1, 1)), (sobel, (1, 2, 1)), (scharr, (3, 10, 3))):
        got = impulse_response(maker(0, [1], 2, sign))
        assert (got == sign * np.outer([1, 0, -1], k)).all()
    assert (impulse_response(laplace([0, 1], 2, sign)) == sign * np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])).all()
    assert impulse_response(along(Convolution, [5, 7], 0, 1)).tolist() == [5, 7]


def test_templates(image):
    raster, values = image
    t = np.arange(1, 10.0)
    box = Box((-1, -1), (1, 1))
    got = apply_filter(pearson(t, box), raster, Nearest()).to_numpy().T
    assert np.allclose(got, plain(values, box, Nearest(), lambda n: np.corrcoef(n, t)[0, 1]))
    got = apply_filter(quotient(t, box), raster, Nearest()).to_numpy().T
    assert np.allclose(got, plain(values, box, Nearest(), lambda n: (n / t).min() * np.sqrt(9 / ((n / t) ** 2).sum())))


def test_pad(image):
    raster, values = image
    box = Box((-2, -3), (10, 8))
    assert (pad(raster, box, Nearest()).to_numpy().T == np.pad(values, [(2, 2), (3, 2)], "edge")).all()
    assert (pad(raster, box, Periodic()).to_numpy().T == np.pad(values, [(2, 2), (3, 2)], "wrap")).all()
    assert (pad(raster, box, Constant(7)).to_numpy().T == np.pad(values, [(2, 2), (3, 2)], constant_values=7)).all()


@pytest.mark.parametrize("how", [Nearest(), Constant(2.0)])
def test_chunks_exchange_their_margins(spark, how):
    shape, tile = (23, 17, 3), (5, 4, 2)
    chunks = filled_chunks(spark, shape, tile, lambda x, y, z: np.sin(x * 3.0 + y * y + 7 * z))
    pixels = Raster(to_pixels(chunks, 3), shape).check()
    for f in (Convolution(list(range(18)), Box((-1, -4, 0), (1, 1, 0))), sobel(0, [1, 2], 3), Median(Box((2, 0, 0), (4, 1, 0)))):
        want = apply_filter(f, pixels, how).to_numpy()
        got = Raster(to_pixels(filter_chunks(chunks, f, shape, tile, how), 3), shape).to_numpy()
        assert np.allclose(got, want)
    both = combine_chunks(chunks, filled_chunks(spark, shape, tile, lambda x, y, z: x + 10.0 * y), lambda a, b: a * b)
    x, y = np.arange(23)[None, None, :], np.arange(17)[None, :, None]
    assert np.allclose(Raster(to_pixels(both, 3), shape).to_numpy(), pixels.to_numpy() * (x + 10.0 * y))
