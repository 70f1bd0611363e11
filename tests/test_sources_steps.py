"""Files, chunk streams, pipelines of steps, options."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe import operator_queries, queries  # noqa: F401
from voxelframe.plans.errors import FileFormatError, PathMissingError, PathTakenError
from voxelframe.plans.raster import Raster
from voxelframe.plans.regions import Box
from voxelframe.plans.steps import Options, Step, StepPipeline, Timer
from voxelframe.sources import fits
from voxelframe.sources.fits import BLOCK, from_planes, read_fits, read_fits_chunks, read_info, read_pixels, sections, to_planes, write_fits
from voxelframe.streaming.chunks import chunk_totals, crop_chunks, map_chunks, read_chunk_stream, to_chunks, to_pixels


@pytest.mark.parametrize("kind", ["uint8", "int8", "int16", "uint16", "int32", "uint32", "int64", "float32", "float64"])
def test_fits_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / "a.fits")
    values = (np.arange(16 * 15) % 120 if "int" in kind else np.linspace(-3, 3, 240)).astype(kind).reshape(15, 16)
    raster = Raster.from_numpy(spark, values.astype(np.int64) if kind.startswith("uint") or kind == "int8" else values)
    write_fits(raster, path, "x", kind)
    assert (tmp_path / "a.fits").stat().st_size % BLOCK == 0
    assert (read_fits(spark, path).to_numpy() == values).all()
    with pytest.raises(PathTakenError):
        write_fits(raster, path, "x", kind)
    write_fits(raster.apply(lambda v: v + 1), path, "a", kind)
    assert [tuple(r["shape"]) for r in read_info(spark, path).orderBy("hdu").collect()] == [(16, 15)] * 2
    assert np.allclose(read_fits(spark, path, 1, "double").to_numpy(), values.astype(float) + 1, rtol=1e-6)
    write_fits(raster, path, "w", kind)
    assert read_info(spark, path).count() == 1


def test_fits_values_beyond_the_type(spark, tmp_path):
    """They aren't wrapped around: an error, or digits in planes."""
    path = str(tmp_path / "a.fits")
    values = np.array([[0, 255, 256, 833], [70_000, 1 << 40, 7, (1 << 62) + 3]])
    raster = Raster.from_numpy(spark, values)
    for bad, kind in ((raster, "uint8"), (raster.apply(lambda v: -v), "int16"), (raster.apply(lambda v: F.lit(float("nan"))), "int32")):
        with pytest.raises(Exception, match="doesn't hold"):
            write_fits(bad, path, "x", kind)
    for kind, n in (("uint8", 8), ("int16", 5), ("int64", 1), ("float32", 3)):
        for r in [raster] if kind == "uint8" else [raster, raster.apply(lambda v: 7 - v)]:
            planes = to_planes(r, kind)
            assert planes.shape == (4, 2, n)
            write_fits(planes, path, "w", kind)
            assert (from_planes(read_fits(spark, path), kind).to_numpy() == r.to_numpy()).all()
    assert to_planes(raster.apply(lambda v: v % 256), "uint8").shape == (4, 2, 1)


def test_fits_of_large_counts(spark, tmp_path):
    """A table of more than 255 events an hour."""
    times = spark.range(720).selectExpr("timestamp_seconds(1704067200 + id * 3600) AS ts")
    times.crossJoin(spark.range(300)).select("ts").write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES["fits_uint8"](spark, str(tmp_path)).collect()
    assert len(got) == 720 and {r["v"] for r in got} == {300.0}


def test_fits_errors(spark, tmp_path):
    raster = Raster.range(spark, (2, 2))
    with pytest.raises(PathMissingError):
        read_fits(spark, str(tmp_path / "no.fits"))
    with pytest.raises(PathMissingError):
        write_fits(raster, str(tmp_path / "no.fits"), "a")
    with pytest.raises(ValueError, match="mode"):
        write_fits(raster, str(tmp_path / "no.fits"), "q")
    with pytest.raises(FileFormatError):
        write_fits(raster, str(tmp_path / "no.fits"), "x", "bool")
    (tmp_path / "bad.fits").write_bytes(b"nothing like it")
    with pytest.raises(Exception, match="not a FITS file"):
        read_info(spark, str(tmp_path / "bad.fits")).collect()


def test_fits_sections(spark, tmp_path):
    """Sections are stretches of the file that cover every pixel once, each of at most the asked size."""
    for shape, most in (((7, 5, 3), 10), ((7, 5, 3), 3), ((7, 5, 3), 1000), ((9,), 4), ((4, 1, 6), 8), ((3, 3), 6)):
        at = 0
        for first, box in sections(shape, most):
            assert first == at and box.size <= most
            where = np.array([np.ravel_multi_index(p, shape, order="F") for p in box])
            assert sorted(where.tolist()) == list(range(at, at + box.size))
            at += box.size
        assert at == np.prod(shape)


def test_fits_read_by_many_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.fits")
    values = np.arange(40 * 30 * 2.0).reshape(2, 30, 40)
    write_fits(Raster.from_numpy(spark, values), path)
    raster = read_fits(spark, path, section=400)
    assert raster.df.rdd.getNumPartitions() == 6
    assert (raster.to_numpy() == values).all()
    cut = read_fits(spark, path, region=Box((3, 12, 1), (9, 18, 7)), section=40)
    assert cut.shape == (7, 7, 1) and cut.front == (3, 12, 1)
    assert cut.df.rdd.getNumPartitions() == 7
    assert (cut.to_numpy() == values[1:, 12:19, 3:10]).all()
    chunks = read_fits_chunks(spark, path, section=400)
    assert chunks.count() == 6 and max(len(r["values"]) for r in chunks.collect()) == 400
    assert (Raster(to_pixels(chunks, 3), (40, 30, 2)).to_numpy() == values).all()
    write_fits(Raster.from_numpy(spark, values + 1), str(tmp_path / "b.fits"))
    both = read_pixels(spark, str(tmp_path / "*.fits"), 3).groupBy("path").agg(F.sum("v").alias("s")).collect()
    assert sorted(r["s"] for r in both) == [values.sum(), values.sum() + values.size]
    assert {r["path"].rsplit("/", 1)[1] for r in both} == {"a.fits", "b.fits"}


def test_fits_small_sections_share_tasks(spark, tmp_path):
    """Tasks grow with the pixels, not with the number of sections; chunks and boxes stay as they are cut."""
    path = str(tmp_path / "a.fits")
    values = np.arange(8 * 1500 * 2.0).reshape(2, 1500, 8)
    write_fits(Raster.from_numpy(spark, values), path)
    chunks = read_fits_chunks(spark, path, section=24)
    assert chunks.count() == 1000 and chunks.rdd.getNumPartitions() <= fits.TASKS
    assert (Raster(to_pixels(chunks, 3), (8, 1500, 2)).to_numpy() == values).all()
    for region in (Box((1, 4, 0), (6, 1490, 1)), Box((0, 1499, 1), (0, 1499, 1)), Box((0, 5, 0), (7, 400, 1))):
        cut = read_fits(spark, path, region=region, section=24)
        assert cut.df.rdd.getNumPartitions() <= fits.TASKS
        want = values[region.front[2] : region.back[2] + 1, region.front[1] : region.back[1] + 1, region.front[0] : region.back[0] + 1]
        assert (cut.to_numpy() == want).all()


@pytest.mark.parametrize("placed", [True, False])
def test_fits_writing(spark, tmp_path, monkeypatch, placed):
    """Sections of many tasks, whichever way they are put together; the old file stays if a pixel is missing or twice."""
    monkeypatch.setattr(fits, "SECTION", 64)
    path = str(tmp_path / "a.fits")
    values = np.arange(33 * 11.0).reshape(11, 33)
    raster = Raster.from_numpy(spark, values)
    write_fits(raster, path, placed=placed)
    write_fits(raster.apply(lambda v: -v), path, "a", "int32", placed)
    before = (tmp_path / "a.fits").read_bytes()
    assert len(before) % BLOCK == 0
    assert (read_fits(spark, path).to_numpy() == values).all() and (read_fits(spark, path, 1).to_numpy() == -values).all()
    short = Raster(raster.df.where("x0 <> 7"), raster.shape)
    twice = Raster(raster.df.union(raster.df.where("x0 = 7 AND x1 = 3")), raster.shape)
    for bad in (short, twice):
        with pytest.raises(Exception, match="size|pixel twice"):
            write_fits(bad, path, "w", placed=placed)
        assert (tmp_path / "a.fits").read_bytes() == before
        assert [p.name for p in tmp_path.iterdir()] == ["a.fits"]


def test_fits_shifted_front(spark, tmp_path):
    values = np.arange(12.0).reshape(3, 4)
    moved = Raster.from_numpy(spark, values)
    moved = Raster(moved.df.select((F.col("x0") + 5).alias("x0"), (F.col("x1") - 2).alias("x1"), "v"), moved.shape, (5, -2))
    write_fits(moved, f"file:{tmp_path}/a.fits")
    assert (read_fits(spark, f"file://{tmp_path}/a.fits").to_numpy() == values).all()


def test_chunks_on_a_stream(spark, tmp_path):
    raster = Raster.range(spark, (10, 7))
    chunks = to_chunks(raster, (4, 3))
    assert chunks.count() == 9
    chunks.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_chunk_stream(spark, str(tmp_path / "in"), 2, 1)
    pixels = to_pixels(map_chunks(crop_chunks(stream, Box((0, 0), (3, 2))), lambda v: v + 1), 2)
    run = pixels.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got = {(r["x0"], r["x1"]): r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(a, b): a + 10 * b + 1.0 for a in range(4) for b in range(3)}
    assert chunk_totals(chunks).agg(F.sum("sum"), F.sum("n")).first()[:] == (sum(range(70)), 70)


def test_steps(spark):
    ran = []

    def note(name, *inputs):
        ran.append(name)
        return spark.range(3 + len(inputs)) if name == 2 else name

    one = Step("one", lambda: note(1))
    two = Step("two", lambda a: note(2, a), [one])
    three = Step("three", lambda a: note(3, a), [one])
    four = Step("four", lambda b, c: note(4, b, c), [two, three])
    line = StepPipeline()
    assert not line.evaluated(one)
    assert line.get(four) == 4 and line.get(four) == 4 and ran == [1, 2, 3, 4]
    assert line.evaluated(two) and line.get(two).count() == 4 and line.milliseconds(two) > 0
    assert line.milliseconds() == pytest.approx(sum(line.milliseconds(s) for s in (one, two, three, four)))
    line.reset()
    assert not line.evaluated(four)


def test_timer_and_options():
    t = Timer()
    t.start()
    t.split()
    t.stop()
    assert len(t.laps) == 2 and t.least <= t.most <= t.total
    with pytest.raises(RuntimeError):
        t.stop()
    o = Options("test")
    o.positional("input")
    o.named("radius", default=3, kind=int, implicit=7)
    o.flag("loud")
    got = o.parse(["a.fits", "--radius", "--loud"])
    assert (got["input"], got["radius"], got["loud"]) == ("a.fits", 7, True)
    assert "radius" in o.help()


def test_programs(spark, tmp_path):
    from voxelframe.programs import mask_cosmics, turn_square

    path = str(tmp_path / "s.fits")
    turn_square.main([path, "--side", "24"], spark)
    first, second = read_fits(spark, path).to_numpy(), read_fits(spark, path, 1).to_numpy()
    assert first.sum() == 13 * 13 and abs(second.sum() - 13 * 13 * 2.25) < 13
    mask_cosmics.main([path, "--output", str(tmp_path / "m.fits"), "--rounds", "1"], spark)
    assert set(np.unique(read_fits(spark, str(tmp_path / "m.fits")).to_numpy())) <= {0, 1}
