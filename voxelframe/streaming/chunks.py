"""Streams of chunks: rows that hold a whole block of pixels each.

Pixel functions, box cuts and reductions need nothing but the chunk, so they run unchanged on a stream. Filters need
neighbouring chunks and are for batches only: a chunk sends its neighbours the margins they need and stays whole itself,
so what is shuffled is the raster once and its margins, eight bytes a pixel.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stencil import Constant, Extrapolation, Filter, Nearest, Periodic
from ..plans.errors import SizeError
from ..plans.raster import Raster
from ..plans.regions import Box, axes


_NUMPY = {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}
_SPARK = {v: k for k, v in _NUMPY.items()}


def chunk_schema(kind: str = "double") -> str:
    """Schema of chunk files: front and shape of a block, its values (axis 0 fastest)."""
    return f"front array<long>, shape array<long>, values array<{kind}>"


def to_chunks(raster: Raster, tile: Sequence[int], kind: str = "double") -> DataFrame:
    """One row per tile, its values of the Spark type ``kind``. A tile must fit an executor's row; a few hundred thousand pixels are a good size.

    Every tile must be whole: one that lacks pixels, or has one twice, raises an error.
    """
    keys = [f"t{k}" for k in range(raster.dimension)]
    front = [F.col(k) * t + f for k, t, f in zip(keys, tile, raster.front, strict=True)]
    shape = [F.least(F.lit(t), F.lit(f + s) - x) for t, f, s, x in zip(tile, raster.front, raster.shape, front, strict=True)]
    local, stride = F.lit(0).cast("long"), F.lit(1).cast("long")
    for a, x, s in zip(raster.axes, front, shape, strict=True):
        local = local + (F.col(a) - x) * stride
        stride = stride * s
    rows = raster.tiled(tile).select(*keys, local.alias("i"), F.col("v").cast(kind).alias("v"))
    packed = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("values"))
    whole = F.lit(1).cast("long")
    for s in shape:
        whole = whole * s
    checked = F.when(F.size("values") == whole, F.col("values")).otherwise(F.raise_error(F.lit("size: a tile lacks pixels or has one twice")))
    return packed.select(F.array(*front).alias("front"), F.array(*(s.cast("long") for s in shape)).alias("shape"), checked.alias("values"))


def to_pixels(chunks: DataFrame, dimension: int) -> DataFrame:
    """(x0, …, v) of chunks; works on streams."""
    rows = chunks.select("front", "shape", F.posexplode("values").alias("i", "v"))
    out, left = [], F.col("i").cast("long")
    for k, a in enumerate(axes(dimension)):
        size = F.get("shape", F.lit(k))
        out.append((F.get("front", F.lit(k)) + left % size).alias(a))
        left = ((left - left % size) / size).cast("long")
    return rows.select(*out, "v")


def read_chunk_stream(spark: SparkSession, path: str, dimension: int, files_a_batch: int = 64) -> DataFrame:
    """A stream of the Parquet chunk files of one dimension that arrive in a folder."""
    return spark.readStream.schema(chunk_schema()).option("maxFilesPerTrigger", files_a_batch).parquet(path).where(F.size("front") == dimension)


def map_chunks(chunks: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """A pixel function within each chunk."""
    return chunks.withColumn("values", F.transform("values", f))


def crop_chunks(chunks: DataFrame, box: Box) -> DataFrame:
    """Chunks that touch a box; the cut of pixels comes after ``to_pixels``."""
    meets = F.lit(True)
    for k, (f, b) in enumerate(zip(box.front, box.back, strict=True)):
        at, size = F.get("front", F.lit(k)), F.get("shape", F.lit(k))
        meets = meets & (at <= b) & (at + size > f)
    return chunks.where(meets)


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """n, sum, min and max of each chunk; sums over a stream follow by ``groupBy``."""
    value = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return chunks.select("front", F.size("values").cast("long").alias("n"), value.alias("sum"), F.array_min("values").alias("min"), F.array_max("values").alias("max"))


def _kind(chunks: DataFrame) -> np.dtype:
    """The NumPy type of the values of chunks."""
    return np.dtype(_NUMPY[chunks.schema["values"].dataType.elementType.simpleString()])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray]]:
    """Front and values (axes in raster order) of each chunk; the last three columns of a batch. Null values are none at all."""
    front, shape, values = batch.columns[-3:]
    flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in values.value_lengths().to_pylist())])
    for f, n, a, b in zip(front.to_pylist(), shape.to_pylist(), ends, ends[1:], strict=False):
        yield f, flat[a:b].reshape(n, order="F") if n is not None else flat[a:b]


def _row(front: Sequence[int], block: np.ndarray, **more: int) -> pa.RecordBatch:
    cols = {k: pa.array([v], pa.int64()) for k, v in more.items()}
    cols |= {"front": pa.array([[int(x) for x in front]], pa.list_(pa.int64())), "shape": pa.array([list(block.shape)], pa.list_(pa.int64()))}
    flat = pa.array(np.ascontiguousarray(block.reshape(-1, order="F")))
    return pa.RecordBatch.from_arrays([*cols.values(), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], [*cols, "values"])


def filled_chunks(spark: SparkSession, shape: Sequence[int], tile: Sequence[int], f: Callable[..., np.ndarray]) -> DataFrame:
    """Chunks of ``f`` of the coordinates (arrays that broadcast against one another), made on the executors."""
    counts = [-(-s // t) for s, t in zip(shape, tile, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at = np.unravel_index(k, counts, order="F")
                lanes = [np.arange(a * t, min((a + 1) * t, s)) for a, t, s in zip(at, tile, shape, strict=True)]
                block = np.broadcast_to(f(*np.ix_(*lanes)), [len(x) for x in lanes])
                yield _row([x[0] for x in lanes], block.astype(np.float64))

    n = math.prod(counts)
    return spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, chunk_schema())


def combine_chunks(a: DataFrame, b: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of the values of two rasters cut into the same chunks; pixels aren't rows.

    Chunks meet by their keys if both have them (stored with buckets they meet without a shuffle), else by their fronts.
    A chunk that one side lacks becomes NaN; among whole numbers, which have none, it raises an error.
    """
    on = "key" if "key" in a.columns and "key" in b.columns else "front"
    kind = np.result_type(_kind(a), _kind(b))
    other = b.select(F.col(on).alias("_on"), F.col("front").alias("_front"), F.col("shape").alias("_shape"), F.col("values").alias("_values"))
    met = a.join(other, F.col(on) == F.col("_on"), "full")
    both = met.select(F.coalesce("front", "_front").alias("front"), F.coalesce("shape", "_shape").alias("shape"), "values", F.col("_values").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [math.prod(x) for x in batch.column(1).to_pylist()]
            sides = []
            for column in batch.columns[2:]:
                lengths = column.value_lengths().to_pylist()
                if any(n is not None and n != size for n, size in zip(lengths, sizes, strict=True)):
                    raise SizeError(lengths, sizes)
                if None in lengths:
                    if kind.kind in "iu":
                        raise SizeError("a missing chunk", "all chunks, as whole numbers have no NaN")
                    full = np.full(sum(sizes), math.nan, kind)
                    full[np.repeat([n is not None for n in lengths], sizes)] = column.flatten().to_numpy(zero_copy_only=False)
                    sides.append(full)
                else:
                    sides.append(column.flatten().to_numpy(zero_copy_only=False))
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.asarray(f(*sides), kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["front", "shape", "values"])

    return both.mapInArrow(run, chunk_schema(_SPARK[kind.name]))


# -- pieces that chunks send one another


def turns(own: Box, all_: Box, domain: Box, how: Extrapolation) -> Iterator[tuple[int, ...]]:
    """By how much a chunk is moved to be seen from ``all_``: not at all, or by any whole number of periods."""
    if not isinstance(how, Periodic):
        yield (0,) * len(domain.shape)
        return
    lanes = [range(-(-(f - b) // n), (e - a) // n + 1) for a, b, f, e, n in zip(own.front, own.back, all_.front, all_.back, domain.shape, strict=True)]
    for at in itertools.product(*lanes):
        yield tuple(k * n for k, n in zip(at, domain.shape, strict=True))


def tile_box(number: int | Sequence[int], shape: Sequence[int], tile: Sequence[int]) -> Box:
    """The box of a tile of a shape, by its number (axis 0 fastest) or its place."""
    counts = [-(-s // t) for s, t in zip(shape, tile, strict=True)]
    at = [int(x) for x in np.unravel_index(number, counts, order="F")] if isinstance(number, int) else number
    return Box(tuple(a * t for a, t in zip(at, tile, strict=True)), tuple(min((a + 1) * t, s) - 1 for a, t, s in zip(at, tile, shape, strict=True)))


def exchange(chunks: DataFrame, shape: Sequence[int], tile: Sequence[int], send: Callable[[Box], Iterator[tuple[Sequence[int], Box, Sequence[int]]]], make: Callable[[Box, list[tuple[list[int], np.ndarray]]], np.ndarray], kind: np.dtype, origin: Sequence[int] = ()) -> DataFrame:
    """The tiles of ``shape``, each made of the pieces that chunks send it.

    ``send`` tells for the box of a chunk the place of each tile that wants some of it, the box of what it wants, and
    by how much that is moved. ``make`` turns a tile's box and its pieces (fronts and values) into values. Every tile is
    made, also of no pieces at all. What is shuffled is the pieces, so about the raster once. ``origin`` is the front of
    the result.
    """
    counts = [-(-s // t) for s, t in zip(shape, tile, strict=True)]
    element = chunks.schema["values"].dataType.elementType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for front, block in _blocks(batch):
                own = Box(tuple(front), tuple(x + m - 1 for x, m in zip(front, block.shape, strict=True)))
                for at, part, by in send(own):
                    piece = block[tuple(slice(a - o, b - o + 1) for a, b, o in zip(part.front, part.back, front, strict=True))]
                    yield _row([a + m for a, m in zip(part.front, by, strict=True)], piece, target=int(np.ravel_multi_index(tuple(at), counts, order="F")))

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for number, part in zip(batch.column(0).to_pylist(), _blocks(batch), strict=True):
                if number != now:
                    if now is not None:
                        yield made(now, parts)
                    now, parts = number, []
                if part[0] is not None:
                    parts.append(part)
        if now is not None:
            yield made(now, parts)

    def made(number: int, parts: list[tuple[list[int], np.ndarray]]) -> pa.RecordBatch:
        box = tile_box(number, shape, tile)
        return _row([f + o for f, o in zip(box.front, origin or (0,) * len(shape), strict=True)], np.asarray(make(box, parts), kind))

    sent = chunks.select("front", "shape", "values").mapInArrow(cut, "target long, " + chunk_schema(element))
    n = math.prod(counts)
    wanted = chunks.sparkSession.range(n).select(F.col("id").alias("target"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in sent.schema.fields[1:]))
    return sent.union(wanted).repartition("target").sortWithinPartitions("target").mapInArrow(receive, chunk_schema(_SPARK[kind.name]))


def assemble(held: Box, parts: list[tuple[list[int], np.ndarray]], kind: np.dtype) -> np.ndarray:
    """The values of a box from pieces; what none of them covers is NaN, or an error among whole numbers."""
    whole = kind.kind in "iu"
    values = np.zeros(held.shape, kind) if whole else np.full(held.shape, math.nan, kind)
    seen = 0
    for front, block in parts:
        values[tuple(slice(x - o, x - o + m) for x, o, m in zip(front, held.front, block.shape, strict=True))] = block
        seen += block.size
    if whole and seen != held.size:
        raise SizeError(seen, held.size)
    return values


def extended(values: np.ndarray, held: Box, halo: Box, how: Extrapolation) -> np.ndarray:
    """Values of ``held``, the part of ``halo`` within the domain, continued to all of ``halo``."""
    pads = [(a - b, c - d) for a, b, c, d in zip(held.front, halo.front, halo.back, held.back, strict=True)]
    if not any(map(any, pads)):
        return values
    return np.pad(values, pads, "edge") if isinstance(how, Nearest) else np.pad(values, pads, constant_values=how.value)


def filter_chunks(chunks: DataFrame, f: Filter, shape: Sequence[int], tile: Sequence[int], how: Extrapolation = Nearest()) -> DataFrame:
    """A filter over a raster of ``shape`` (from 0) that is cut into tiles; the result is cut alike.

    A missing pixel is NaN, as is what is made of it, never part of the border; whole numbers stay whole where the
    filter keeps them, and there a missing pixel raises an error.
    """
    n, one = len(shape), (1,) * len(shape)
    reach = f.reach | Box((0,) * n, (0,) * n)
    domain = Box.from_shape(shape)
    counts = [-(-s // t) for s, t in zip(shape, tile, strict=True)]
    kind = _kind(chunks) if f.whole and (not isinstance(how, Constant) or float(how.value).is_integer()) else np.dtype(float)

    def send(own: Box) -> Iterator[tuple[Sequence[int], Box, Sequence[int]]]:
        for by in turns(own, domain.grow(reach), domain, how):
            moved = own + by
            lanes = [range(max(0, (a - hi) // t), min(c, (b - lo) // t + 1)) for a, b, t, c, lo, hi in zip(moved.front, moved.back, tile, counts, reach.front, reach.back, strict=True)]
            for at in itertools.product(*lanes):
                part = tile_box(at, shape, tile).grow(reach) & moved
                if part.size:
                    yield at, part - by, by

    def make(box: Box, parts: list[tuple[list[int], np.ndarray]]) -> np.ndarray:
        halo = box.grow(reach)
        held = halo if isinstance(how, Periodic) else halo & domain
        values = extended(assemble(held, parts, kind), held, halo, how)
        trim = tuple(slice(a - b, m - (d - c)) for a, b, c, d, m in zip(f.reach.front, reach.front, f.reach.back, reach.back, halo.shape, strict=True))
        return f.slide(values[trim], one)

    return exchange(chunks, shape, tile, send, make, kind)
