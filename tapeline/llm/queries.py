"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bloom, divergence, jaccard, langid, lines, mixing, oracles, packing, quality, rtree, scoring, sharding, topk
from .common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(packing.TOKENIZER)


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pseudo_likelihood(read(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.quality_rules(read(spark, sf_dir, "documents"))
    return found.drop("char_distance", "word_distance")


def op7_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, with the first slot of each; odd rows as in ``mixing.mix``."""
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read(spark, sf_dir, "documents")).drop("languages", "shares")


def op9_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.hierarchical(docs, read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(read(spark, sf_dir, "documents"))


def op11_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated texts of all documents; odd rows as in ``bloom.exact_dedup``."""
    return bloom.exact_dedup(read(spark, sf_dir, "documents"))


def op12_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels shifted where vec_id is divisible by 7; odd rows as in ``rtree.hard_negatives``."""
    rows = read(spark, sf_dir, "embeddings")
    return rtree.hard_negatives(rows, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of each language; odd rows as in ``audit.source_audit``."""
    return audit.source_audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pseudo_likelihood, op2_exact_top_k, op3_minimax_shards, op4_ngram_jaccard, op5_vector_packing, op6_divergence_rules,
    op7_low_discrepancy_mix, op8_language_mixture, op9_hierarchical_quality, op10_line_dedup,
    op11_bloom_dedup, op12_rtree_negatives, op13_source_audit,
)}

#: The others have no SQL form; tests hold them against plain Python.
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
