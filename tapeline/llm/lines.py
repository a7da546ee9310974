"""Line dedup: lines that many documents share are dropped, except in the last document that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free, stored

MIN_CHARS = 20
MIN_DOCS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys(text: Column) -> Column:
    """A key for each line: stripped, A-Z in lower case."""
    return F.transform(lines(F.translate(text, UPPER, LOWER)), lambda x: F.btrim(x, F.lit(SPACES)))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row_key, doc, drop): positions of the lines to drop, for each row that has some.

    Lines are exploded with the digest of their key; distinct documents are counted for each digest, after a
    partial count on the map side, and the digests over the threshold are joined back to the lines. Neither step
    gathers the rows of a digest: the count is a partial aggregate, and the join is one that can be split.
    """
    hashed = F.transform(keys(F.col("text")), lambda x: F.when(F.char_length(x) >= min_chars, F.md5(x.cast("binary"))))
    exploded = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("row_key"), F.posexplode(hashed).alias("pos", "hash")).where("hash IS NOT NULL")
    exploded = exploded.withColumn("hash", F.unhex("hash"))
    shared = exploded.groupBy("hash", "doc").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("doc").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs).select("hash", "last")
    shared = stored(shared)  # with a shuffle of its own on either side, Spark can split a frequent line in the join
    hit = exploded.join(shared, "hash").where(~F.col("doc").eqNullSafe(F.col("last")))
    return hit.groupBy("row_key", "doc").agg(F.collect_set("pos").alias("drop"))


def clean(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, Column, Column, Column]:
    """(``docs`` with a column of its own for what goes, number of lines, number of dropped ones, text that is left).

    A null or empty text is one empty line. Documents are counted by distinct doc_id; a row without doc_id counts
    for none and holds no line for good. Rows of one doc_id are cleaned each by itself, and equal rows alike. Very
    long texts are cleaned whole. Other columns may have any name. An empty table gives no rows.
    """
    # collect_set holds positions of one row, no more than its own lines
    key, doc, drop = free(docs, "row_key", "doc", "drop")
    found = dropped_lines(docs, min_chars, min_docs).toDF(key, doc, drop)
    joined = docs.join(found, (F.xxhash64(docs["doc_id"], docs["text"]) == F.col(key)) & docs["doc_id"].eqNullSafe(F.col(doc)), "left").select(*[docs[c] for c in docs.columns], drop)
    all_lines = lines(F.col("text"))
    left = F.transform(F.array(all_lines), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drop)), lambda i: F.get(ls, i)))[0]
    kept = F.when(F.col(drop).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n"))
    return joined, F.size(all_lines).cast("long"), F.coalesce(F.size(drop), F.lit(0)).cast("long"), kept


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256. See ``clean`` for odd rows."""
    done, n, dropped, kept = clean(docs.select("doc_id", "text"), **options)
    return done.select("doc_id", n.alias("n_lines"), dropped.alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def apply_line_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with cleaned texts. A document all of whose lines went keeps an empty text; a null text stays. See
    ``clean`` for other odd rows."""
    done, _, _, kept = clean(docs, **options)
    text = F.when(F.col("text").isNotNull(), kept)
    return done.select(*[(F.char_length(text).cast(docs.schema[c].dataType) if c == "n_chars" else text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns])
