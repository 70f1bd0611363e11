"""Helpers shared by the text operators: the shared scratch folder, materialised tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the operators understand it: blank and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where neither that setting nor a checkpoint folder exists
    (tests in local mode) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="voxelframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back; cuts the lineage there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast of an already materialised ``df`` if it has at most ``most_rows`` rows, else leave the join to Spark."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """Tells rows of one id apart where ids are repeated."""
    return F.xxhash64(text.cast("string"))


def batched(docs: DataFrame, rows: int = 512) -> DataFrame:
    """``docs``, with the session's Arrow batches set to ``rows`` rows: texts are long, and a batch is held by the JVM and by Python."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return docs


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the system at its end: a Python worker lives on, and what it keeps is missing to its executor."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        # Only the GNU C library has it.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole
