"""Regions: order, algebra, and the same cells through every kind of region."""

import pytest

from voxelframe.plans.errors import OutOfBoundsError, SizeError
from voxelframe.plans.raster import Raster, same, scan_order
from voxelframe.plans.regions import Box, Grid, Mask, Positions, index_of, line, shape_size, span


def test_grid_order_and_trim():
    g = Grid((1, 2), (6, 7), (2, 3))
    assert g.back == (5, 5)
    assert list(g) == [(1, 2), (3, 2), (5, 2), (1, 5), (3, 5), (5, 5)]
    assert (3, 5) in g and (2, 5) not in g
    assert g[(1, 1)] == (3, 5)
    assert list(g & Box((2, 0), (9, 4))) == [(3, 2), (5, 2)]
    assert list(g & Box((-9, -9), (99, 99))) == list(g)


def test_box_algebra():
    a, b = Box((0, 0), (4, 5)), Box((2, -1), (9, 3))
    assert (a & b) == Box((2, 0), (4, 3))
    assert (a | b) == Box((0, -1), (9, 5))
    assert a.grow(Box((-1, -2), (3, 0))) == Box((-1, -2), (7, 5))
    assert a.shrink(Box((-1, -2), (3, 0))) == Box((1, 2), (1, 5))
    assert -b == Box((-9, -3), (-2, 1))
    assert a + 1 == Box((1, 1), (5, 6)) and a - (1, 2) == Box((-1, -2), (3, 3))
    assert Box((1, 1), (2, 2)) < a and Box((0, 1), (2, 2)) <= a and not Box((0, 1), (2, 2)) < a
    assert a.project(1) == Box((0, 0), (0, 5)) and a.erase(0) == Box((0,), (5,)) and a.erase(0).insert(0, 0, 4) == a
    assert a.extend((7,), (8,)) == Box((0, 0, 7), (4, 5, 8))
    assert a.clamp((-3, 99)) == (0, 5) and a.wrap((-1, 0)) == (4, 0)
    assert Box.from_center(1, (5, 5)) == Box((4, 4), (6, 6)) and len(a) == 30
    assert (Box.whole(2) & a) == a and Box.whole(1).wrap((3,)) == (3,)
    flags = [p[0] == p[1] for p in a]
    assert set(Mask.from_flags(a, flags)) == {(k, k) for k in range(5)}
    with pytest.raises(SizeError):
        Mask.from_flags(a, flags[1:])
    with pytest.raises(OutOfBoundsError):
        a.wrap((5, 0))
    with pytest.raises(SizeError):
        Box((0,), (1, 2))


@pytest.mark.parametrize("power", [0, 1, 2])
def test_ball(power):
    got = set(Mask.ball(2, (0, 0, 0), power))
    near = lambda d: sum(x != 0 for x in d) <= 1 if power == 0 else sum(abs(x) ** power for x in d) <= 2**power
    assert got == {p for p in Box.from_center(2, (0, 0, 0)) if near(p)}


def test_same_cells_through_every_region(spark):
    r = Raster.range(spark, (4, 5, 6))
    box = Box((1, 0, 2), (2, 3, 4))
    want = sorted(index_of(r.shape, p) for p in box)
    values = lambda region: sorted(x["v"] for x in r.patch(region).collect())
    assert values(box) == want
    assert values(Grid(box.front, box.back, (1, 1, 1))) == want
    assert values(Mask.of(box)) == want
    assert values(Mask(box, lambda c: c[0] >= 0)) == want
    assert values(Positions.of(spark, list(box))) == want
    assert [x["v"] for x in scan_order(r.patch(box), 3).collect()] == want
    assert values(line((1, 0, 2), 1, 4, 2)) == [index_of(r.shape, p) for p in ((1, 0, 2), (1, 2, 2), (1, 4, 2))]
    assert values(Mask.of(box) + (1, 0, 0)) == sorted(index_of(r.shape, p) for p in box + (1, 0, 0))
    assert sorted(map(tuple, Mask.ball(1, (2, 2)).positions(spark).collect())) == sorted(Mask.ball(1, (2, 2)))
    assert Positions.of(spark, list(box)).bounding_box() == box
    assert list(span(2, 9, 3)) == [(2,), (5,), (8,)]


def test_views(spark):
    r = Raster.range(spark, (4, 3, 2)).check()
    a = r.to_numpy()
    assert a[1, 2, 3] == r.at((3, 2, 1)) == r.at((-1, -1, -1)) == 23
    assert (r.section(1).to_numpy() == a[1]).all()
    assert (r.chunk(0, 0).to_numpy() == a[:1]).all()
    assert (r.row((-1, 0)).to_numpy() == a[0, 2]).all()
    assert (r.profile(2, (1, 1)).to_numpy() == a[:, 1, 1]).all()
    assert (r.slice(Box((0, 1, 1), (3, 2, 1)), 2).to_numpy() == a[1, 1:]).all()
    assert r.is_contiguous(Box((0, 1, 1), (3, 2, 1)), 2) and not r.is_contiguous(Box((1, 1, 1), (3, 2, 1)), 2)
    with pytest.raises(SizeError):
        r.slice(Box((1, 1, 1), (3, 2, 1)), 2)
    with pytest.raises(OutOfBoundsError):
        r.at((4, 0, 0))
    assert r.elided() == "[0, 1, 2 ... 21, 22, 23]"
    assert Raster.range(spark, (3,)).elided() == "[0, 1, 2]"
    assert same(r, r.apply(lambda v: v + 0)) and not same(r, r.apply(lambda v: v + 1))
    with pytest.raises(SizeError):
        r.apply(lambda a, b: a + b, r.section(0))
    with pytest.raises(SizeError):
        Raster.from_values(spark, [1, 2, 3], (2, 2))
    assert shape_size((2, 0)) == 0
