"""The operators of this subpackage as queries over the standard tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .edit_matching import find_leaks
from .hard_negatives import mine, mine_sql
from .language_id import cross_checked
from .line_quality import quality_report, report_sql
from .lm_scoring import score, score_sql
from .mixing import EPOCHS, SEED, WEIGHTS, mix, mix_sql, standard_levels
from .pii import find_pii
from .secret_forest import find_secrets
from .sharding import shard_documents
from .simhash import near_duplicates
from .source_audit import audit, audit_sql
from .token_counts import count_tokens
from .token_files import token_digest


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)

#: The share of all tokens that the production mix wants.
MIX_SHARE = 0.8


def op1_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), standard_levels(), WEIGHTS, share=MIX_SHARE, epochs=EPOCHS, seed=SEED)


def op2_offset_preserving_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op3_random_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), path_col="source")


def op4_cross_document_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), weights=[1.0] * 40, grown_weights=[1.0] * 41)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_range_ans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", end_id=2)


def op8_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json", limit=2048)


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    scored = score(table(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op10_pigeonhole_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op12_slotted_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", changed), F.col("vec_id") % 100 == 0)


def op13_output_code_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_checked(table(spark, sf_dir, "documents"))


QUERIES = {
    "op3_random_forest_secret_scan": op3_random_forest_secret_scan,
    "op9_cross_entropy_difference": op9_cross_entropy_difference,
    "op1_hierarchical_mix": op1_hierarchical_mix,
    "op5_rendezvous_sharding": op5_rendezvous_sharding,
    "op2_offset_preserving_pii": op2_offset_preserving_pii,
    "op10_pigeonhole_edit_matching": op10_pigeonhole_edit_matching,
    "op4_cross_document_line_frequency": op4_cross_document_line_frequency,
    "op8_rank_synchronous_token_counts": op8_rank_synchronous_token_counts,
    "op6_range_ans_token_files": op6_range_ans_token_files,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op11_source_divergence_audit": op11_source_divergence_audit,
    "op12_slotted_hard_negatives": op12_slotted_hard_negatives,
    "op13_output_code_language_id": op13_output_code_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_hierarchical_mix": mix_sql(MIX_SHARE),
    "op4_cross_document_line_frequency": report_sql(),
    "op9_cross_entropy_difference": score_sql(),
    "op11_source_divergence_audit": audit_sql(),
    "op12_slotted_hard_negatives": mine_sql(),
}
