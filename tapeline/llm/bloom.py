"""Exact dedup by two passes of a Bloom filter: only rows that may be repeated are shuffled.

The first pass fills a filter of counters that stop at two. Each partition adds up its own hashes and puts out the cells
it touched, once or more, in segments; segments are summed apart from each other, and what is left of them is one bit a
cell, set where two hashes or more met. The second pass tests every row: one of whose cells has met no other hash is
alone for certain and passes straight through, and the others are grouped by their digests, which decides exactly.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, stored
from .lines import LOWER, UPPER

#: Cells a row, and the least and most cells of a filter (as powers of two). The filter is one bit a cell, 128 MB at most.
#: It has all its cells up to 67 million rows; beyond that more rows than the repeated ones are taken for repeated and
#: shuffled, 50 bytes each, and the result is the same.
CELLS_A_ROW, LEAST, MOST = 16, 13, 30
#: Cells of a segment (as a power of two), rows of a partition that are added up at a time, tasks of one group of copies.
SEGMENT, ROWS_AT_ONCE, SALTS = 20, 1 << 20, 64


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case. Of ASCII alone, ``lower`` changes nothing else and is faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def cells(h: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash, from its low and its high bits."""
    u = h.astype(np.int64).view(np.uint64)
    return (u & np.uint64((1 << power) - 1)).astype(np.int64), (u >> np.uint64(64 - power)).astype(np.int64)


class Bits:
    """The cells in which two hashes or more met. Segments stay compressed until a worker first asks."""

    def __init__(self, power: int, segments: dict[int, bytes]):
        self.power, self.segments, self.bits = power, segments, None

    def __getstate__(self):
        return {"power": self.power, "segments": self.segments, "bits": None}

    def both(self, h: np.ndarray) -> np.ndarray:
        """Whether both cells of each hash are set."""
        if self.bits is None:
            size = 1 << min(SEGMENT, self.power)
            self.bits = np.zeros((1 << self.power) // 8, np.uint8)
            for k, packed in self.segments.items():
                self.bits[k * size // 8 : (k + 1) * size // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
        low, high = cells(h, self.power)
        on = lambda at: (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return (on(low) & on(high)).astype(bool)


def touched(power: int):
    """First pass over one partition: (segment, cells met once, cells met more often)."""
    width = min(SEGMENT, power)

    def summed(parts):
        low, high = cells(np.concatenate(parts), power)
        at, n = np.unique(np.concatenate([low, high[high != low]]), return_counts=True)
        cut = np.flatnonzero(np.diff(at >> width)) + 1
        for some, many in zip(np.split(at, cut), np.split(n, cut), strict=True):
            if len(some):
                inside = (some & ((1 << width) - 1)).astype("<u4")
                yield pa.RecordBatch.from_pydict({"segment": pa.array([int(some[0] >> width)], pa.int32()), "once": [inside[many == 1].tobytes()], "more": [inside[many > 1].tobytes()]})

    def run(batches):
        parts, held = [], 0
        for b in batches:
            parts.append(b.column(0).to_numpy(zero_copy_only=False))
            held += b.num_rows
            if held >= ROWS_AT_ONCE:
                yield from summed(parts)
                parts, held = [], 0
        if held:
            yield from summed(parts)

    return run


def filled(hashes: DataFrame, rows: int) -> Bits:
    """The filter of all hashes (h long)."""
    power = int(np.clip(np.ceil(np.log2(max(1, rows) * CELLS_A_ROW)), LEAST, MOST))
    width = min(SEGMENT, power)

    def merged(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(1 << width, np.uint8)
        for once, more in zip(g.once, g.more, strict=True):
            at = np.frombuffer(once, "<u4")
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more, "<u4")] = 2
        return pd.DataFrame({"segment": [key[0]], "bits": [zlib.compress(np.packbits(count > 1).tobytes(), 1)]})

    parts = hashes.select("h").mapInArrow(touched(power), "segment int, once binary, more binary")
    # one row a segment, 1,024 segments of 128 KB at most
    found = parts.groupBy("segment").applyInPandas(merged, "segment int, bits binary").collect()
    return Bits(power, {r["segment"]: bytes(r["bits"]) for r in found})


def may_repeat(bits: Bits, df: DataFrame, h: Column) -> Column:
    """Second pass: false for rows that are alone for certain. Only the hashes go to Python."""
    held = df.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(held.value.both(h.to_numpy()))

    return test(h)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    A null text is an empty one, and empty texts are equal. Of equal texts the row with the largest doc_id stays; a
    missing doc_id is smaller than any other, and of rows that repeat the largest one exactly one stays. Very long texts
    are read whole, once. Other columns are ignored; an empty table gives no rows.

    Rows that may be repeated are grouped after a partial count by digest and one of ``SALTS`` numbers, by which they also
    meet their group's row again, so a group of any size is dealt to that many tasks.
    """
    narrow = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("sha")))
    narrow = narrow.withColumn("h", F.xxhash64("sha"))
    tested = stored(narrow.withColumn("maybe", may_repeat(filled(narrow, narrow.count()), narrow, F.col("h"))).drop("h"))
    alone = tested.where("NOT maybe")
    some = tested.where("maybe").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    parts = some.groupBy("sha", "salt").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top"))
    groups = parts.groupBy("sha").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.collect_list("salt").alias("salts"))
    met = some.join(groups.select("sha", "n", "top", F.explode("salts").alias("salt")), ["sha", "salt"])
    columns = lambda keep, n, kept: ("doc_id", keep.alias("keep_id"), n.alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.select(*columns(F.col("doc_id"), F.lit(1).cast("long"), F.lit(True))).unionAll(met.select(*columns(F.col("top.doc_id"), F.col("n"), F.col("row") == F.col("top.row"))))


def apply_exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``exact_dedup``. Rows that are alone for certain keep
    their place and aren't shuffled. Of rows that share both text and doc_id the one with the largest hash of all its
    columns stays."""
    sha, h, maybe = free(docs, "sha", "h", "maybe")
    hashes = stored(docs.select(F.xxhash64(digest(F.col("text"))).alias("h")))
    marked = docs.withColumn(sha, digest(F.col("text"))).withColumn(h, F.xxhash64(F.col(sha)))
    marked = marked.withColumn(maybe, may_repeat(filled(hashes, hashes.count()), docs, F.col(h)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    last = marked.where(F.col(maybe)).groupBy(sha).agg(F.max_by(F.struct(*names), F.struct(F.col("doc_id"), F.xxhash64(*names))).alias(h))
    return marked.where(~F.col(maybe)).select(*names).unionAll(last.select(f"{h}.*"))
