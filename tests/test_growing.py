"""Masks grown to their end, against a plain flood."""

import math

import numpy as np
import pytest

from voxelframe.operators import growing
from voxelframe.operators.cosmics import segment
from voxelframe.operators.growing import Tile, grow
from voxelframe.plans.raster import Raster
from voxelframe.plans.regions import Box


def plain(image, mask, threshold):
    """Flags spread from pixel to pixel until nothing changes; arrays in raster order."""
    seen, todo = mask != 0, list(zip(*np.nonzero(mask), strict=True))
    while todo:
        at = todo.pop()
        n = image[at]
        for k in range(image.ndim):
            for d in (-1, 1):
                to = tuple(x + d * (j == k) for j, x in enumerate(at))
                if all(0 < x < s - 1 for x, s in zip(to, image.shape, strict=True)) and not seen[to] and n != 0 and not math.isnan(n) and (n - image[to]) / n < threshold:
                    seen[to] = True
                    todo.append(to)
    return seen.astype(int)


def rasters(spark, *arrays):
    return [Raster.from_numpy(spark, np.ascontiguousarray(a.T)) for a in arrays]


def snake(rows, width):
    """A bright line that goes to and fro through a dark image."""
    image = np.ones((width, 4 * rows + 1))
    for k in range(rows):
        image[1:-1, 4 * k + 2] = 100.0
        image[(-2 if k % 2 == 0 else 1), 4 * k + 2 : 4 * k + 7] = 100.0
    return image


def test_snake_in_few_rounds(spark, monkeypatch):
    image = snake(6, 40)
    mask = np.zeros(image.shape, int)
    mask[1, 2] = 1
    told = []
    real = growing._stored
    monkeypatch.setattr(growing, "_stored", lambda df, name: told.append(name) or real(df, name))
    got = grow(*rasters(spark, image, mask), 0.5, (8, 6)).to_numpy().T
    assert (got == plain(image, mask, 0.5)).all() and got.sum() > 200
    assert told.count("told") <= 3


@pytest.mark.parametrize("threshold", [0.5, -0.05, 0.02])
def test_like_a_plain_flood(spark, threshold):
    rng = np.random.default_rng(int(threshold * 100) % 50)
    image = rng.uniform(1, 3, (21, 17)) if threshold > 0 else np.add.outer(np.arange(21.0), np.arange(17.0)) ** 2 + rng.uniform(0, 8, (21, 17)) + 1
    image[5, 5], image[9, 3] = 0.0, math.nan
    mask = (rng.uniform(size=image.shape) < 0.03).astype(int)
    got = grow(*rasters(spark, image, mask), threshold, (5, 7)).to_numpy().T
    assert (got == plain(image, mask, threshold)).all() and got.sum() > mask.sum()


def test_is_the_end_of_rounds(spark):
    rng = np.random.default_rng(2)
    image, mask = rng.uniform(1, 3, (9, 8)), np.zeros((9, 8), int)
    mask[4, 4] = mask[0, 0] = 1
    i, m = rasters(spark, image, mask)
    rounds = m
    for _ in range(3):
        rounds = segment(i, rounds, 0.3)
        rounds = Raster(spark.createDataFrame(rounds.df.collect(), rounds.df.schema), rounds.shape)
    end = grow(i, m, 0.3, (4, 3)).to_numpy()
    assert (end >= rounds.to_numpy()).all()
    assert (grow(i, Raster.from_numpy(spark, end), 0.3, (4, 3)).to_numpy() == end).all()
    nothing = grow(i, m.apply(lambda v: v * 0), 0.3, (4, 3))
    assert not nothing.to_numpy().any()


def test_three_axes_and_front(spark):
    rng = np.random.default_rng(9)
    image, mask = rng.uniform(1, 3, (7, 6, 5)), (rng.uniform(size=(7, 6, 5)) < 0.02).astype(int)
    mask[3, 3, 2] = 1
    i, m = rasters(spark, image, mask)
    assert (grow(i, m, 0.4, (3, 4, 2)).to_numpy().T == plain(image, mask, 0.4)).all()
    moved = [Raster(r.df.selectExpr("x0 - 4 AS x0", "x1 + 7 AS x1", "x2", "v"), r.shape, (-4, 7, 0)) for r in (i, m)]
    got = grow(*moved, 0.4, (3, 4, 2))
    assert got.front == (-4, 7, 0) and (got.crop(got.domain).to_numpy().T == plain(image, mask, 0.4)).all()


def test_parts_of_a_tile():
    image = np.array([[1.0, 1, 9, 9], [1, 9, 9, 1], [1, 1, 1, 1]])
    domain = Box((-9, -9), (9, 9))
    tile = Tile(np.pad(image, 1, constant_values=math.nan), np.zeros((5, 6)), Box((-1, -1), (3, 4)), Box((0, 0), (2, 3)), domain, 0.5)
    label = tile.parts().reshape((5, 6), order="F")[1:-1, 1:-1]
    assert (label[image == 9] == label[0, 2]).sum() >= 4 and len(np.unique(label[image == 9])) == 1 and len(np.unique(label[image == 1])) == 1
