"""Chunk stores, masks as run lengths, transforms of long lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators.spectra import complex_dft, inverse_complex_dft, inverse_real_dft, real_dft
from voxelframe.operators.summed_area import box_sums, summed_area
from voxelframe.plans import spans
from voxelframe.plans.errors import SizeError
from voxelframe.plans.raster import Raster
from voxelframe.plans.regions import Box, Grid, Mask
from voxelframe.plans.spans import Spans
from voxelframe.sources.chunk_store import cut_chunks, keyed, read_chunks, store_table, write_chunks
from voxelframe.streaming.chunks import combine_chunks, filled_chunks, to_chunks, to_pixels

# -- stores


def scanned(df):
    """Rows that the scan of a query hands on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.length()))


def test_a_small_box_reads_few_chunks(spark, tmp_path):
    chunks = filled_chunks(spark, (512, 512), (16, 16), lambda x, y: x + 512.0 * y)
    write_chunks(chunks, str(tmp_path / "store"), (16, 16), row_group=1 << 15)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        box = Box((100, 300), (130, 330))
        met = read_chunks(spark, str(tmp_path / "store"), box).select("key", "front")
        assert met.count() == 9 and scanned(met) < 200
        assert scanned(read_chunks(spark, str(tmp_path / "store")).select("key", "front")) == 1024
        assert "LessThanOrEqual(f0,130)" in met._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = Raster(to_pixels(cut_chunks(read_chunks(spark, str(tmp_path / "store")), box), 2), box.shape).to_numpy()
    assert (got == np.add.outer(512.0 * np.arange(300, 331), np.arange(100, 131))).all()
    grid = Grid((3, 5), (500, 400), (7, 9))
    got = Raster(to_pixels(cut_chunks(read_chunks(spark, str(tmp_path / "store")), grid), 2), grid.shape).to_numpy()
    assert (got == np.add.outer(512.0 * np.arange(5, 401, 9), np.arange(3, 501, 7))).all()


def test_keys_are_neighbours(spark):
    chunks = filled_chunks(spark, (64, 64, 64), (8, 8, 8), lambda x, y, z: x + y + z)
    rows = keyed(chunks, 3, (8, 8, 8)).select("key", "f0", "f1", "f2", "b0").collect()
    assert sorted(r["key"] for r in rows) == list(range(512))
    # The first eight keys are a cube.
    assert max(max(r["f0"], r["f1"], r["f2"]) for r in rows if r["key"] < 8) == 8 and all(r["b0"] == r["f0"] + 7 for r in rows)
    with pytest.raises(SizeError):
        keyed(chunks, 3, (8, 8))


def test_buckets_meet_without_a_shuffle(spark, tmp_path):
    tables = [store_table(filled_chunks(spark, (60, 50), (16, 16), lambda x, y, k=k: x + k * y), f"vf_bucket_{k}", str(tmp_path / f"t{k}"), (16, 16), 4) for k in (1, 3)]
    try:
        both = combine_chunks(*tables, lambda a, b: a + b)
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        got = Raster(to_pixels(both, 2), (60, 50)).to_numpy()
        assert (got == 2 * np.arange(60) + 4 * np.arange(50)[:, None]).all()
    finally:
        for k in (1, 3):
            spark.sql(f"DROP TABLE vf_bucket_{k}")


# -- run lengths


def points(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("cell", [1 << 16, 7])
def test_algebra_of_spans(spark, monkeypatch, cell):
    monkeypatch.setattr(spans, "CELL", cell)
    rng = np.random.default_rng(1)
    sets = [{tuple(map(int, p)) for p in rng.integers(-12, 20, (250, 2))} for _ in range(2)]
    a, b = (Spans.of_positions(spark.createDataFrame([p for p in s for _ in range(2)], "x0 long, x1 long"), 2) for s in sets)
    u, v = sets
    box = Box((-3, 0), (9, 11))
    for got, want in ((a, u), (a | b, u | v), (a & b, u & v), (a - b, u - v), (a ^ b, u ^ v), (a & box, {p for p in u if p in box}), (a.translate((5, -3)), {(x + 5, y - 3) for x, y in u}), (a.mirror(), {(-x, -y) for x, y in u}), (a - a, set())):
        rows = got.positions().collect()
        assert len(rows) == len(want) == got.size() and {tuple(r) for r in rows} == want
    # Stretches don't touch within a cell.
    rows = [r for r in (a | b).df.collect()]
    ends = {(r["x1"], r["cell"], r["high"] + 1) for r in rows}
    assert not any((r["x1"], r["cell"], r["low"]) in ends for r in rows)
    lanes = list(zip(*u, strict=True))
    assert a.box() == Box(tuple(map(min, lanes)), tuple(map(max, lanes))) and (a - a).box() is None


def test_spans_of_regions_and_flags(spark):
    ball, box = Mask.ball(4, (3, 2, 1)), Box((1, 0, 2), (6, 3, 2))
    for region in (ball, box, Grid((0, 1, 0), (9, 7, 3), (2, 3, 1))):
        assert points(Spans.of_region(spark, region).positions()) == {tuple(r) for r in region.positions(spark).collect()}
    raster = Raster.range(spark, (9, 7))
    flags = Spans.of_flags(raster.apply(lambda v: v % 4))
    assert points(flags.select(raster).select("v")) == {(v,) for v in range(63) if v % 4}
    written = flags.apply(raster, lambda v: v * 0).to_numpy().ravel()
    assert (written == [0 if v % 4 else v for v in range(63)]).all()
    line = Spans.of_stretches(spark.createDataFrame([(5, 9), (1, 3), (4, 4), (20, 19)], "low long, high long"), 1)
    assert [tuple(r) for r in line.df.select("low", "high").collect()] == [(1, 9)]


def test_a_large_mask_selects_by_a_join(spark):
    """A million flagged positions in one line, in cells, with no list of them in the plan."""
    raster = Raster.filled(spark, (3_000_000,), F.col("idx"))
    flags = Spans.of_positions(raster.df.where("x0 % 3 = 1").select("x0"), 1)
    got = flags.select(raster)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert got.agg(F.count("v"), F.sum("v")).first()[:] == (1_000_000, sum(range(1, 3_000_000, 3)))


# -- long lines


def complex_numpy(raster):
    rows = raster.df.select("*", "v.re", "v.im").toPandas()
    out = np.empty(raster.shape, complex)
    out[tuple(rows[a] for a in raster.axes)] = rows["re"] + 1j * rows["im"]
    return out.T


@pytest.mark.parametrize("n", [64, 90, 37, 74, 7, 1])
def test_long_lines(spark, n):
    rng = np.random.default_rng(n)
    values = rng.normal(size=(3, n))
    raster = Raster.from_numpy(spark, values)
    half = real_dft(raster, axes=[0], line=8)
    assert half.shape == (n // 2 + 1, 3)
    assert np.allclose(complex_numpy(half), np.fft.rfft(values, axis=1))
    whole = real_dft(raster, line=8)
    assert np.allclose(complex_numpy(whole), np.fft.fft(np.fft.rfft(values, axis=1), axis=0))
    assert np.allclose(inverse_real_dft(whole, raster.shape, line=8).to_numpy(), values)
    there = complex_dft(raster, line=8)
    assert np.allclose(complex_numpy(there), np.fft.fft2(values))
    assert np.allclose(complex_numpy(inverse_complex_dft(there, line=8)), values)


def test_a_line_over_many_tasks(spark):
    """2 ** 18 values in lines of 512 at most: no task holds more than a few of them, and the transform is NumPy's."""
    n = 1 << 18
    raster = Raster.filled(spark, (n,), (F.col("idx") * 7919 % 1009).cast("double"))
    got = real_dft(raster, line=512)
    want = np.fft.rfft(np.arange(n) * 7919 % 1009)
    rows = got.df.where("x0 % 4099 = 5").select("x0", "v.re", "v.im").collect()
    assert len(rows) > 20 and all(abs(complex(r["re"], r["im"]) - want[r["x0"]]) < 1e-5 for r in rows)


# -- summed areas


@pytest.mark.parametrize(("shape", "tile"), [((23, 17), (5, 4)), ((9, 8, 7), (4, 3, 5)), ((30,), (7,)), ((6, 5), (6, 5))])
def test_summed_areas(spark, shape, tile):
    rng = np.random.default_rng(3)
    values = rng.integers(-9, 2**40, shape)
    raster = Raster.from_numpy(spark, np.ascontiguousarray(values.T))
    want = values
    for k in range(len(shape)):
        want = want.cumsum(axis=k)
    table = summed_area(to_chunks(raster, tile, "bigint"), shape, tile)
    assert (Raster(to_pixels(table, len(shape)), shape).to_numpy().T == want).all()
    ends = [np.sort(rng.integers(-4, max(shape) + 4, (2, len(shape))), axis=0) for _ in range(40)]
    ends += [ends[0][::-1] + [[3], [0]]]
    rows = [(k, *map(int, e[0]), *map(int, e[1])) for k, e in enumerate(ends)]
    boxes = spark.createDataFrame(rows, "id long, " + ", ".join(f"{s}{k} long" for s in "fb" for k in range(len(shape))))
    got = {r["id"]: r["sum"] for r in box_sums(table, boxes, shape, tile).collect()}
    for k, (f, b) in enumerate(ends):
        cut = values[tuple(slice(max(0, x), max(0, y + 1)) for x, y in zip(f, b, strict=True))]
        assert got[k] == (cut.sum() if (f <= b).all() else 0), (f, b)
    real = summed_area(to_chunks(raster, tile), shape, tile)
    assert np.allclose(Raster(to_pixels(real, len(shape)), shape).to_numpy().T, want)
    with pytest.raises(ValueError, match="tiles"):
        summed_area(to_chunks(raster, tile).where("front[0] > 0 OR element_at(front, -1) > 0"), shape, tile)
