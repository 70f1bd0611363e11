"""Summed-area tables of rasters in chunk form: each value is the sum of all pixels up to it along every axis.

A tile sums its own pixels. What lies before it is made of the tiles before it: for every choice of axes, the tiles that
come earlier along these and stand beside it along the others count with their sums over the chosen axes, running along
the others. Such messages (faces, edges and totals of tiles) are far smaller than the tiles, and they are added up along
one axis after the other as they stream by.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path
from ..streaming.chunks import _blocks, _kind, tile_box

#: Corners up to this many go to every task; beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def summed_area(chunks: DataFrame, shape: Sequence[int], tile: Sequence[int]) -> DataFrame:
    """(tile, front, shape, values) for chunks of a raster of ``shape`` from 0, cut into tiles; ``tile`` numbers them, axis 0 fastest.

    Whole numbers are summed exactly in 64 bits, others as doubles. Every tile must be there, or an error is raised.
    """
    n, spark = len(shape), chunks.sparkSession
    counts = [-(-s // t) for s, t in zip(shape, tile, strict=True)]
    whole = _kind(chunks).kind in "iu"
    kind, element = (np.dtype(np.int64), "bigint") if whole else (np.dtype(float), "double")
    names, schema = ["chosen", "tile", "values"], f"chosen int, tile long, values array<{element}>"

    def row(chosen: int, number: int, values: np.ndarray) -> pa.RecordBatch:
        flat = pa.array(np.ascontiguousarray(values.reshape(-1, order="F"), kind))
        return pa.RecordBatch.from_arrays([pa.array([chosen], pa.int32()), pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for front, block in _blocks(batch):
                number = int(np.ravel_multi_index([f // t for f, t in zip(front, tile, strict=True)], counts, order="F"))
                for chosen in range(1 << n):
                    part = block.astype(kind)
                    for k in range(n):
                        part = part.sum(axis=k, keepdims=True) if chosen >> k & 1 else part.cumsum(axis=k)
                    yield row(chosen, number, part)

    def along(axis: int) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Messages of tiles in a line, replaced by the sum of those before."""
            now, before = None, None
            for batch in batches:
                for chosen, number, values in zip(batch["chosen"].to_pylist(), batch["tile"].to_pylist(), batch["values"], strict=True):
                    at = np.unravel_index(number, counts, order="F")
                    line = (chosen, *(int(a) for k, a in enumerate(at) if k != axis))
                    own = values.values.to_numpy(zero_copy_only=False)
                    if line != now:
                        now, before = line, np.zeros(len(own), kind)
                    yield row(chosen, number, before)
                    before = before + own

        return run

    path = scratch_path(spark, "sums")
    chunks.select("front", "shape", "values").mapInArrow(told, schema).write.partitionBy("chosen").parquet(path)
    kept = spark.read.schema("tile long, values array<" + element + ">, chosen int").parquet(path).select(names)
    messages = kept.where("chosen > 0")
    for axis in range(n):
        step, size = math.prod(counts[:axis]), counts[axis]
        line, place = F.expr(f"tile - ((tile div {step}) % {size}) * {step}"), F.expr(f"(tile div {step}) % {size}")
        mine = messages.where(F.col("chosen").bitwiseAND(1 << axis) != 0)
        summed = mine.select("*", line.alias("line"), place.alias("place")).repartition("chosen", "line").sortWithinPartitions("chosen", "line", "place").select(names).mapInArrow(along(axis), schema)
        messages = messages.where(F.col("chosen").bitwiseAND(1 << axis) == 0).union(summed)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            for chosen, number, values in zip(batch["chosen"].to_pylist(), batch["tile"].to_pylist(), batch["values"], strict=True):
                box, own = tile_box(number, shape, tile), values.values.to_numpy(zero_copy_only=False)
                if chosen == 0:
                    if now is not None:
                        yield done(now, sums)
                    now, sums = number, own.reshape(box.shape, order="F").copy()
                else:
                    sums += own.reshape([1 if chosen >> k & 1 else s for k, s in enumerate(box.shape)], order="F")
        if now is not None:
            yield done(now, sums)

    def done(number: int, sums: np.ndarray) -> pa.RecordBatch:
        box, flat = tile_box(number, shape, tile), pa.array(np.ascontiguousarray(sums.reshape(-1, order="F")))
        cols = [pa.array([number], pa.int64()), *(pa.array([list(x)], pa.list_(pa.int64())) for x in (box.front, box.shape)), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)]
        return pa.RecordBatch.from_arrays(cols, ["tile", "front", "shape", "values"])

    if (found := kept.where("chosen = 0").count()) != math.prod(counts):
        raise ValueError(f"{found} tiles where {math.prod(counts)} are expected")
    together = kept.where("chosen = 0").union(messages).repartition("tile").sortWithinPartitions("tile", "chosen")
    return together.mapInArrow(added, f"tile long, front array<long>, shape array<long>, values array<{element}>")


def box_sums(table: DataFrame, boxes: DataFrame, shape: Sequence[int], tile: Sequence[int], key: Sequence[str] = ("id",)) -> DataFrame:
    """The columns ``key`` of ``boxes`` with the ``sum`` of the pixels of each box (f0, …, b0, …, bounds included), by a value for each of its corners.

    What lies outside the raster counts nothing, a box without pixels sums to 0. ``key`` must tell boxes apart.
    """
    n, zero = len(shape), F.lit(0).cast("long")
    low = [F.greatest(F.col(f"f{k}").cast("long"), zero) for k in range(n)]
    high = [F.least(F.col(f"b{k}").cast("long"), F.lit(s - 1)) for k, s in enumerate(shape)]
    corners, places = [], [f"_p{k}" for k in range(n)]
    for before in itertools.product((False, True), repeat=n):
        at = [low[k] - 1 if b else high[k] for k, b in enumerate(before)]
        corners.append(F.struct(F.lit(-1 if sum(before) % 2 else 1).alias("_sign"), *(c.alias(a) for c, a in zip(at, places, strict=True))))
    some = F.lit(True)
    for a, b in zip(low, high, strict=True):
        some = some & (a <= b)
    asked = boxes.where(some).select(*key, F.explode(F.array(*corners)).alias("_c")).select(*key, "_c.*")
    for a in places:
        asked = asked.where(F.col(a) >= 0)
    number, offset, step, stride = zero, zero, 1, F.lit(1).cast("long")
    for a, s, t in zip(places, shape, tile, strict=True):
        place = F.expr(f"{a} div {t}")
        number, offset = number + place * step, offset + (F.col(a) % t) * stride
        step, stride = step * -(-s // t), stride * F.least(F.lit(t), s - place * t)
    asked = asked.select(*key, "_sign", number.alias("_tile"), offset.cast("int").alias("_offset"))
    few = F.broadcast(asked) if asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else asked
    read = table.select(F.col("tile").alias("_tile"), F.col("values").alias("_values")).join(few, "_tile").select(*key, (F.col("_sign") * F.get("_values", F.col("_offset"))).alias("_part"))
    sums = read.groupBy(*key).agg(F.sum("_part").alias("sum"))
    return boxes.select(*key).join(sums, list(key), "left").select(*key, F.coalesce("sum", F.lit(0)).alias("sum"))
