"""Sharding by minimax contiguous partition of ordered atomic groups.

Equal texts form a group that is never split. Groups are ordered by the digest of their text. The smallest
capacity with which a greedy pass fills at most the given number of shards is found by binary search, and the
groups are cut there. The driver never sees all groups: it works on nodes, sums over ranges of digests, and opens
only those nodes in which a cut can still fall (see ``Cuts``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LAW = "bytes"
SHARDS = 24
#: Hexadecimal digits by which nodes are opened: 4096 nodes at first, 256 for each node after that.
FIRST, MORE = 3, 2
#: Parts of a shard, numbered one by one for its slots.
CELLS = 1024


class Cuts:
    """Nodes in order: (prefix of the digest, bytes, bytes of its largest group, number of groups)."""

    def __init__(self, nodes: list[tuple[str, int, int, int]], shards: int):
        self.nodes, self.shards = sorted(nodes), shards
        self.ends = list(accumulate(n[1] for n in self.nodes))
        self.most = max((n[2] for n in self.nodes), default=0)

    def greedy(self, capacity: int, divisible: bool) -> list[int] | None:
        """Bytes before each shard's end, filled greedily, or None if the shards don't hold all. A node of several
        groups can end a shard anywhere if divisible (no group order can do better), else only at its end."""
        total, at, ends = (self.ends or [0])[-1], 0, []
        for _ in range(self.shards):
            if at >= total:
                ends.append(at)
                continue
            i = bisect_right(self.ends, at + capacity)
            end = self.ends[i - 1] if i else 0
            if divisible and i < len(self.nodes) and self.nodes[i][3] > 1:
                end = at + capacity
            if end <= at:
                return None
            at = min(end, total)
            ends.append(at)
        return ends if at >= total else None

    def smallest(self, divisible: bool) -> int:
        low, high = max(self.most, -(-(self.ends or [0])[-1] // self.shards)), (self.ends or [0])[-1]
        if not divisible:
            low = max([low, *(n[1] for n in self.nodes)])
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, divisible) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def undecided(self) -> list[str]:
        """Prefixes of the nodes of several groups in which a cut of the best partition can fall."""
        low, high = self.smallest(True), self.smallest(False)
        first, last = self.atomic(low), self.greedy(high, True)
        out = set()
        for a, b in zip(first, last, strict=True):
            i = bisect_right(self.ends, a)
            while i < len(self.nodes) and (self.ends[i - 1] if i else 0) <= b:
                if self.nodes[i][3] > 1:
                    out.add(self.nodes[i][0])
                i += 1
        return sorted(out)

    def atomic(self, capacity: int) -> list[int]:
        """As greedy, but nodes are whole and a node too large for a shard ends it where it began: no cut of any
        capacity from this one on comes earlier."""
        total, at, ends = (self.ends or [0])[-1], 0, []
        for _ in range(self.shards):
            i = bisect_right(self.ends, at + capacity)
            at = max(at, self.ends[i - 1] if i else 0)
            ends.append(min(at, total))
        return ends

    def cut(self) -> list[str]:
        """The prefix of the last node of each shard but the last. Within the smallest capacity, cuts are as near
        to equal sizes as the nodes allow; those that leave too much to the right are out."""
        if not self.nodes:
            return []
        capacity, total = self.smallest(False), self.ends[-1]
        ends, earliest, at, out = [0, *self.ends], [total], 0, []
        for _ in range(self.shards - 1):
            earliest.append(ends[bisect_left(ends, earliest[-1] - capacity)])
        for i in range(1, self.shards):
            low = max(at, earliest[self.shards - i])
            a, b = bisect_left(ends, low), bisect_right(ends, at + capacity) - 1
            goal = bisect_left(ends, i * total / self.shards, a, b + 1)
            k = min((x for x in (goal - 1, goal) if a <= x <= b), key=lambda x: (abs(ends[x] - i * total / self.shards), x), default=b)
            at = ends[k]
            out.append(self.nodes[k - 1][0] if k else "")
        return out


def plan(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """(digests of groups with a shard of their own, digests that end the other shards).

    A group of at least the mean size of what is left gets a shard for itself, else the minimax capacity would be
    its size and leave other shards empty. groups: digest, bytes.
    """
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = [(r[0], int(r[1])) for r in groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()]
    own, left, rest = [], total, shards
    for digest, size in top:
        if rest > 1 and size * rest >= left and size > 0 and size < left:
            own.append(digest)
            left, rest = left - size, rest - 1
        else:
            break
    others = groups.where(~F.col("digest").isin(own)) if own else groups
    nodes = sums(others, FIRST)
    while True:
        cuts = Cuts(nodes, rest)
        opened = cuts.undecided()
        if not opened:
            return own, cuts.cut()
        gone = set(opened)
        nodes = [x for x in nodes if x[0] not in gone]
        for width in sorted({len(x) for x in opened}):  # nodes that stayed closed in earlier rounds are shorter
            part = [(x,) for x in opened if len(x) == width]
            inside = others.join(F.broadcast(others.sparkSession.createDataFrame(part, "p string")), F.substring("digest", 1, width) == F.col("p"), "left_semi")
            nodes += sums(inside, width + MORE)


def sums(groups: DataFrame, width: int) -> list[tuple[str, int, int, int]]:
    rows = groups.groupBy(F.substring("digest", 1, width).alias("p")).agg(F.sum("bytes"), F.max("bytes"), F.count("*")).collect()
    return [(r[0], int(r[1]), int(r[2]), int(r[3])) for r in rows]


def shard_of(digest: Column, own: list[str], ends: list[str]) -> Column:
    """A cut ends with the digests that start with its prefix, so digests up to prefix + 'g' belong before it."""
    out = F.lit(0)
    for e in ends:
        out = out + (F.when(digest > F.lit(e + "g"), 1).otherwise(0) if e else F.lit(1))
    for k, d in enumerate(own):
        out = F.when(digest == d, len(ends) + 1 + k).otherwise(out)
    return out.cast("int")


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes (size 8, crc32 0) and is a group of its own, apart from the empty text. Rows of one
    doc_id are documents of their own. Equal rows get different slots. An empty table gives no rows; with fewer
    groups than shards, some shards stay empty. Other columns are ignored.
    """
    text = F.col("text").cast("binary")
    narrow = stored(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(text), F.md5(F.lit("null text").cast("binary"))).alias("digest"),
    ))
    groups = stored(narrow.groupBy("digest").agg(F.sum("size").alias("bytes")))
    own, ends = plan(groups, n)
    rows = narrow.withColumn("shard", shard_of(F.col("digest"), own, ends)).withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(CELLS)).cast("int"))
    cells = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = cells.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("digest", "doc_id")) - 1
    # at most n * CELLS rows, so the broadcast is bounded
    return rows.withColumn("r", inside).join(F.broadcast(before), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("before") + F.col("r")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
