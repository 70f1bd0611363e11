"""Stores of chunks: Parquet in Morton order, so that a small box lies in few row groups, or buckets, so that rasters meet without a shuffle.

A stored chunk has, besides its values, a key (the Morton number of its tile: the bits of its places along all axes,
one axis after the other) and its bounds as plain columns f0, …, b0, …. Their least and greatest values stand in the
file's footer, and Parquet skips the row groups that a box doesn't meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import SizeError
from ..plans.regions import Box, Grid
from ..streaming.chunks import _blocks, _row, chunk_schema

#: Bytes of a row group, about.
ROW_GROUP = 1 << 23


def morton(places: Sequence[Column]) -> Column:
    """The bits of whole numbers, not negative, interleaved; as many of each as fit 63 bits."""
    out, n = F.lit(0).cast("long"), len(places)
    for bit in range(63 // n):
        for k, p in enumerate(places):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(p, bit).bitwiseAND(1).cast("long"), bit * n + k))
    return out


def keyed(chunks: DataFrame, dimension: int, tile: Sequence[int], front: Sequence[int] = ()) -> DataFrame:
    """Chunks of a raster from ``front``, cut into tiles of ``tile``, with their keys and bounds."""
    if len(tile) != dimension:
        raise SizeError(len(tile), dimension)
    lows = [F.get("front", F.lit(k)) for k in range(dimension)]
    places = [((low - o) / t).cast("long") for low, o, t in zip(lows, front or (0,) * dimension, tile, strict=True)]
    highs = [low + F.get("shape", F.lit(k)) - 1 for k, low in enumerate(lows)]
    bounds = [c.alias(f"{side}{k}") for side, cols in (("f", lows), ("b", highs)) for k, c in enumerate(cols)]
    return chunks.select(morton(places).alias("key"), *bounds, "front", "shape", "values")


def write_chunks(chunks: DataFrame, path: str, tile: Sequence[int], front: Sequence[int] = (), row_group: int = ROW_GROUP) -> None:
    """Store chunks in Morton order: files are ranges of it, row groups stretches."""
    ordered = keyed(chunks, len(tile), tile, front).repartitionByRange("key").sortWithinPartitions("key")
    # Row groups are closed at their size, however few chunks that is.
    small = {"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16}
    ordered.write.options(**small).parquet(path)


def meeting(chunks: DataFrame, box: Box) -> DataFrame:
    """Stored chunks that meet a box, by plain columns, so the condition reaches the files."""
    met = F.lit(True)
    for k, (f, b) in enumerate(zip(box.front, box.back, strict=True)):
        met = met & (F.col(f"f{k}") <= b) & (F.col(f"b{k}") >= f)
    return chunks.where(met)


def read_chunks(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """Stored chunks, all or those that meet a box."""
    stored = spark.read.parquet(path)
    return stored if box is None else meeting(stored, box)


def store_table(chunks: DataFrame, table: str, path: str, tile: Sequence[int], buckets: int, front: Sequence[int] = ()) -> DataFrame:
    """Store chunks as a table in buckets of their keys: ``combine_chunks`` of such tables with as many buckets reads both side by side, without a shuffle."""
    # Dealt as the buckets are, so a task writes one file.
    dealt = keyed(chunks, len(tile), tile, front).repartition(buckets, "key")
    dealt.write.bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(table)
    return chunks.sparkSession.table(table)


def cut_chunks(chunks: DataFrame, region: Grid) -> DataFrame:
    """The pixels of a box or grid, as chunks of a raster of the region's shape from 0; a grid's steps become 1.

    Chunks that have none of them vanish. Nothing is shuffled, so the cuts of tiles needn't be tiles of one shape.
    """
    kind = chunks.schema["values"].dataType.elementType.simpleString()
    stored = meeting(chunks, region.box()) if "f0" in chunks.columns else chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for front, block in _blocks(batch):
                own = Box(tuple(front), tuple(f + s - 1 for f, s in zip(front, block.shape, strict=True)))
                part = region & own
                if all(f <= b for f, b in zip(part.front, part.back, strict=True)):
                    cut = block[tuple(slice(f - o, b - o + 1, s) for f, b, s, o in zip(part.front, part.back, region.step, front, strict=True))]
                    yield _row([(f - r) // s for f, r, s in zip(part.front, region.front, region.step, strict=True)], cut)

    return stored.select("front", "shape", "values").mapInArrow(run, chunk_schema(kind))
