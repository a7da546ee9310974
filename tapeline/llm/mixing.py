"""Mixing sources to target weights along a low-discrepancy schedule.

The schedule's points are those of the golden ratio in integers: with consecutive Fibonacci numbers P < M, slot ``j``
has the point ``j * P mod M`` of M, so that each point comes once in M slots and none is rounded, whatever M is. The
points are mapped through the cumulative slots of the targets to sources. A source's documents, shuffled by a hash,
form one stream of words that is cut into blocks of ``MIN_BLOCK`` words; the slot that is the source's r-th takes
block ``r mod blocks``, and the last slot as many words of its block as the target still asks for. So slots grow with
the corpus, and what is taken meets the target at any size.
Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words of a block, at any size of the corpus.
MIN_BLOCK = 16
#: Parts of each source's shuffled stream, so that no source is laid out by one task.
CELLS = 1024
#: Slots ranked together, and groups of slots whose counts are summed together.
PART = 4096


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, repeats: int = MAX_REPEATS) -> list[float]:
    """Targets of sources in the order given: shares of all sizes by weight, at most ``repeats`` times the size;
    what is cut off goes to the others by weight until none is above its limit."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total, open_ = sum(n for _, n in sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    left = total
    while open_:
        w = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] > repeats * sizes[i][1] * w]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / w
            break
        for i in over:
            out[i] = float(repeats * sizes[i][1])
            open_.discard(i)
        left -= sum(repeats * sizes[i][1] for i in over)
    return out


def source_sizes(docs: DataFrame, source: str = "source", size: str = "size") -> list[tuple[str | None, int]]:
    """Sizes by source, in code point order, null last. One row for each source comes to the driver: sources are
    the entries of a mix, not keys that grow with the rows."""
    rows = docs.groupBy(source).agg(F.sum(size).alias("n")).collect()
    return sorted(((r[0], int(r[1] or 0)) for r in rows), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))


def needs(sizes: list[int], goals: list[int], block: int = MIN_BLOCK) -> tuple[list[int], list[int], list[int]]:
    """(blocks, rest, need) of each source: blocks of its stream, words of its goal beyond whole passes through the
    stream, and the slots that passes and rest take."""
    blocks = [max(1, -(-n // block)) for n in sizes]
    rest = [g % n if n else 0 for g, n in zip(goals, sizes, strict=True)]
    return blocks, rest, [(g // n * k if n else 0) + -(-r // block) for g, n, k, r in zip(goals, sizes, blocks, rest, strict=True)]


def lattice(total: int) -> tuple[int, int]:
    """(P, M): the first consecutive Fibonacci numbers of which M is at least ``total``."""
    p, m = 1, 2
    while m < total:
        p, m = m, p + m
    return p, m


def point(slot: Column, p: int, m: int) -> Column:
    """``slot * p mod m``, exact up to 10^18 slots."""
    wide = lambda x: x.cast("decimal(18,0)")
    return (wide(slot) * wide(F.lit(p)) % wide(F.lit(m))).cast("long")


def by_source_of(values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("src"))


def interval(at: Column, bounds: list[int], first: int = 0) -> Column:
    """How many of the ascending bounds are not above ``at``, by halving."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    return F.when(at < F.lit(bounds[k]), interval(at, bounds[:k], first)).otherwise(interval(at, bounds[k + 1 :], first + k + 1))


def points(spark, p: int, m: int) -> DataFrame:
    """(slot, part, at) of all M slots. Only the first point of each part needs decimals; within a part the products are
    below ``PART * M``, so long up to 10^15 slots."""
    tasks = max(spark.sparkContext.defaultParallelism, m >> 25)
    parts = spark.range(0, -(-m // PART), 1, tasks).select(F.col("id").alias("part"), point(F.col("id") * PART, p, m).alias("start"))
    each = parts.select("part", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(PART), F.lit(m) - F.col("part") * PART) - 1)).alias("k"))
    return each.select((F.col("part") * PART + F.col("k")).alias("slot"), "part", ((F.col("start") + F.col("k") * F.lit(p).cast("long")) % F.lit(m).cast("long")).alias("at"))


def ranked(spark, need: list[int]) -> DataFrame:
    """Slots (slot, src, rank) of the schedule: rank counts the slots of source ``src`` from 0 and ends at its need.

    Source i owns at least need[i] of the M points, so all its slots are there once the sequence has run; the
    points that it has beyond its need are the sequence's last and go. Ranks are sums of counts in three steps, slots
    in parts and parts in groups of ``PART`` each, so that a task gets a source's groups at most: one row for 16.8 million slots.
    """
    total = sum(need)
    p, m = lattice(total)
    bounds, at = [], 0
    for n in need[:-1]:
        at += n
        bounds.append(at * m // total if total else 0)
    slots = points(spark, p, m if total else 0).select("slot", interval(F.col("at"), bounds).alias("src"), "part")
    counts = stored(slots.groupBy("src", "part").agg(F.count("*").alias("n")).withColumn("group", F.expr(f"part div {PART}")))
    earlier = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("src", "group").agg(F.sum("n").alias("n")).select("src", "group", earlier(["src"], "group").alias("before_group"))
    before = counts.withColumn("in_group", earlier(["src", "group"], "part")).join(groups, ["src", "group"])
    before = stored(before.select("src", "part", (F.col("in_group") + F.col("before_group")).alias("before")))
    inside = slots.withColumn("r", F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1)
    # the counts grow with the slots: they are merged with the window's rows, which lie and are sorted by these keys already
    return inside.join(before.hint("merge"), ["src", "part"]).select("slot", "src", (F.col("before") + F.col("r")).alias("rank")).where(F.col("rank") < by_source_of(need))


def schedule(spark, sizes: list[int], goals: list[int], block: int = MIN_BLOCK) -> DataFrame:
    """Slots (slot, src, rank, block, words): src is the index of a source, rank counts its slots from 0, and words is
    what it takes of its block. All slots of a source together take its goal."""
    blocks, rest, need = needs(sizes, goals, block)
    pick = by_source_of
    block_ = F.col("rank") % pick(blocks)
    last = (F.col("rank") == pick(need) - 1) & (pick(rest) > 0)
    words = F.least(F.lit(block), pick(sizes) - block_ * block, F.when(last, pick(rest) - block_ * block))
    return ranked(spark, need).select("slot", "src", "rank", block_.alias("block"), words.alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source, and what else it has): doc_id, source, size,
    source_size, target, taken, slot: the schedule's first slot that takes words of the document, null if none does.
    In order of slots, the sources of every prefix are near their targets.

    Null or empty texts have size 0 and are never taken. A null source is a source of its own, the last. Rows of
    one doc_id are documents of their own; ties in the shuffle are split by doc_id and size, so equal rows change
    places at most. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    narrow = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key")))
    by_source = source_sizes(narrow)
    if not by_source:
        return narrow.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("slot"))
    sizes = [n for _, n in by_source]
    goals = targets(by_source, weights, repeats)
    block = MIN_BLOCK
    names = F.array(*[F.lit(s) for s, _ in by_source if s is not None]) if any(s is not None for s, _ in by_source) else F.array().cast("array<string>")
    src = F.when(F.col("source").isNull(), len(by_source) - 1).otherwise(F.array_position(names, F.col("source")) - 1).cast("int")
    rows = narrow.withColumn("src", src).withColumn("cell", F.pmod(F.col("key"), F.lit(CELLS)))
    cells = rows.groupBy("src", "cell").agg(F.sum("size").alias("n"))
    before = cells.select("src", "cell", (F.sum("n").over(Window.partitionBy("src").orderBy("cell")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("src", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_cell", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["src", "cell"]).withColumn("start", F.col("before") + F.col("in_cell"))
    # slots of rank r take block r mod blocks, so whole passes take all words of a document, and those left over
    # its words before the cut; its first slot is that of the block in which it starts, whose rank is the block's number
    goals_ = [int(g + 0.5) for g in goals]
    blocks, rest, need = needs(sizes, goals_, block)
    passes = by_source_of([g // n if n else 0 for g, n in zip(goals_, sizes, strict=True)])
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), by_source_of(rest) - F.col("start")))
    at = placed.withColumn("taken", taken).withColumn("rank", F.when(F.col("taken") > 0, F.expr(f"start div {block}")))
    names = F.get(F.array(*[F.lit(s) for s, _ in by_source]), F.col("src"))
    columns = ["doc_id", names.alias("source"), "size", by_source_of(sizes).alias("source_size"), F.get(F.array(*[F.lit(g) for g in goals]), F.col("src")).alias("target"), "taken", "slot"]
    first = ranked(spark, need).where(F.col("rank") < by_source_of(blocks))
    some = at.where("taken > 0").join(first.hint("merge"), ["src", "rank"]).select(*columns)
    return some.unionByName(at.where("taken = 0").withColumn("slot", F.lit(None).cast("long")).select(*columns))


def apply_mix(docs: DataFrame, ordered: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as its taken words fill it, rounded half up; if
    ``ordered``, sorted by the schedule's slots, at the cost of a shuffle of all texts.

    Rows whose rounded count is 0 go; those without words, of which the mix takes nothing, go too. The columns
    are those of ``docs``, of any name. An empty table gives no rows.
    """
    taken = mix(docs, **options).where("taken > 0").select("doc_id", "source", "size", "taken", "slot")
    # equal rows of one doc_id share their sum
    shares = taken.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"), F.min("slot").alias("slot"))
    copies = F.floor((F.col("taken") * 2 + F.col("size") * F.col("rows")) / (F.col("size") * F.col("rows") * 2)).cast("int")
    doc, source, words, times, slot, copy = free(docs, "doc", "source_", "words", "times", "slot", "copy")
    right = shares.select("doc_id", "source", "size", copies, "slot").toDF(doc, source, words, times, slot).where(F.col(times) > 0)
    joined = docs.join(right, docs["doc_id"].eqNullSafe(F.col(doc)) & docs["source"].eqNullSafe(F.col(source)) & (word_count(docs["text"]) == F.col(words)))
    out = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return (out.orderBy(slot, doc, copy) if ordered else out).select(*[docs[c] for c in docs.columns])
