"""A corpus pipeline: language ID, line dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import jaccard, langid, lines, mixing, packing
from tapeline.llm.common import read, stored
from tapeline.llm.queries import tokenizer_path

#: Rows that a Python task gets at once. An executor holds the texts of a batch several times over, on both sides.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_ROWS`` at most in the session's Python tasks, if it has not asked for smaller ones. The last
    stage runs when its rows are asked for, so the setting stays; all rows are read whatever it is."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.apply_language_id(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.apply_line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.apply_near_duplicates(docs, size=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", language), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The first stage's model and the last stage's tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage works on what its predecessor wrote."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
