"""From raw documents to token files: quality rules, near duplicates, leaks of test items, source weights, token ids.

Every stage is written as Parquet and read again; it works on all that its predecessor kept, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm.common import materialize, table
from voxelframe.llm.edit_matching import drop_leaks
from voxelframe.llm.line_quality import keep_good
from voxelframe.llm.mixing import EPOCHS, SEED, WEIGHTS, mix, standard_levels
from voxelframe.llm.simhash import keep_first
from voxelframe.llm.token_files import token_digest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their host share."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group: 3 bits or fewer, or 0.8 of the shingles of five words."""
    return keep_first(docs, shingle=5, max_bits=3, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), rate=0.1)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, in the proportions of the target weights; documents of scarce sources repeat."""
    return mix(docs, standard_levels(), WEIGHTS, share=1.0, epochs=EPOCHS, seed=SEED, keep_columns=True)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per document."""
    return token_digest(docs, tokenizer="byte_bpe_50k.json", end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

#: SQL can express neither fingerprints nor token ids; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
