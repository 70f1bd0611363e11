"""Sharding by rendezvous hashing: every shard bids for a record, and the best bid wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Stretches of a shard that are numbered side by side.
BUCKETS = 256


def bid(key: Column, shard: int, weight: float) -> Column:
    """Cost of ``shard`` for a key: exponential with rate ``weight``, so the least cost falls to it in that proportion."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(unit) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to n - 1) of a key. Key and weights alone decide.

    A shard's bids don't depend on the others, so a shard that is added or made heavier only takes keys, and one that
    goes or gets lighter only gives up its own. Shards of weight 0 take nothing; equal bids go to the lower shard.
    """
    if any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative, and one of them must be positive")
    bids = [F.struct(bid(key, k, w).alias("cost"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (none for null) plus 16, ``slot`` numbers a shard's rows from 0 without gaps,
    ``grown_shard`` is the shard under ``grown_weights`` (null without). Rows that share an id share a shard; null ids
    are one more key, and a very long text is one row like any other. Other columns are ignored, an empty table gives no rows. A shard is numbered in stretches by
    hash, so no task sorts a whole shard.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col)
    placed = materialize(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            rendezvous(key, weights).alias("shard"),
            (rendezvous(key, grown_weights) if grown_weights else F.lit(None).cast("int")).alias("grown_shard"),
        ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS))),
        "placed",
    )
    counts = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket")
    # At most a row for each shard and bucket: bounded by the arguments, so it may go to every task.
    starts = counts.select("shard", "bucket", (F.sum("count").over(before) - F.col("count")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("n", within).join(F.broadcast(starts), ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("n") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id") -> None:
    """Write ``docs`` with all columns to ``path``, one folder ``shard=N`` for each shard that has rows."""
    docs.withColumn("shard", rendezvous(F.col(id_col), weights)).write.partitionBy("shard").parquet(path)
