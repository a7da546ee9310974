"""How far sources of a language differ in their words: hash-consed segment trees over term ids.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents. They are dealt to blocks by hash; in a block each
source has a segment tree over the terms' ids, whose leaves are the source's counts. Trees are hash-consed: a node is the
number of a distinct count, or of a distinct pair of nodes below it, so equal subtrees, of one source or of several, are
one node. Two trees are priced by walking down both at once; a pair of nodes is met as often as the same two subtrees
face each other, and is priced once. Prices of the blocks add up to the divergence of two sources.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_DOCS, TOP = 30, 50
#: A term's share is counted in units of a 10^9th, after adding ``PRIOR`` to every count.
UNIT, PRIOR = 1_000_000_000, 5
#: Terms of a block, sources of a tile, on average; tasks over which a row of a small table is spread in joins.
BLOCK, TILE, SALTS = 2048, 64, 64
#: ASCII letters and whatever isn't ASCII, in UTF-8.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Entries that a task adds up before it puts them out, and words of a text that are taken at a time.
ENTRIES, WORDS = 300_000, 1 << 16


def counted(batches):
    """(lang, source, term, docs, n) of a partition's documents (lang, source, text as bytes), each maybe several times.
    Every group has an empty term too, with no documents, so that groups without terms are known."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def put():
        for (lang, source), (docs, n) in held.items():
            terms = [b"", *n]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([docs[t] for t in terms], pa.int64()), pa.array([n[t] for t in terms], pa.int64())], names=["lang", "source", "term", "docs", "n"])
        held.clear()

    size = 0
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            # bytes.lower() changes A-Z only
            words, seen = TERM.finditer(text.as_py().lower()), set()
            while some := [m.group() for m in itertools.islice(words, WORDS)]:
                docs, n = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(some)
                docs.update(set(some) - seen)
                seen.update(some)
                size += len(n) - before
                if size >= ENTRIES:
                    yield from put()
                    size = 0
            held.setdefault((lang, source), (Counter(), Counter()))
    yield from put()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * terms)), in whole decimals."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.lit(1).cast("long") + F.call_function("div", (wide(count) + PRIOR) * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + wide(terms) * PRIOR)


def shares(counts: np.ndarray, divisor: int) -> np.ndarray:
    """The same for an array of counts; -1, a place without a term, is left 0."""
    most = max(int(counts.max(initial=0)) + PRIOR, divisor)
    whole = (counts + PRIOR).astype(object if most >= (1 << 63) // UNIT else np.int64)
    return np.where(counts < 0, 0, (1 + UNIT * whole // max(divisor, 1)).astype(np.int64))


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(count of each leaf node, (left, right) of each node by level from the leaves up, root of each row) of counts
    [row, place], where places are a power of two."""
    values, nodes = np.unique(counts, return_inverse=True)
    nodes, levels = nodes.reshape(counts.shape).astype(np.int64), []
    while nodes.shape[1] > 1:
        width = int(nodes.max(initial=0)) + 1
        both = nodes[:, 0::2] * width + nodes[:, 1::2]
        distinct, nodes = np.unique(both, return_inverse=True)
        nodes = nodes.reshape(both.shape).astype(np.int64)
        levels.append((distinct // width, distinct % width))
    return values, levels, nodes[:, 0]


def priced(tree, a: int, others: np.ndarray, divisors: list[int]) -> tuple[np.ndarray, int]:
    """(sum of |share in a - share in b| for each b of ``others``, how many pairs of nodes were priced)."""
    values, levels, roots = tree
    widths = [len(values), *[len(left) for left, _ in levels]]
    row, x, y = np.arange(len(others)), np.full(len(others), roots[a]), roots[others]
    back = []
    for depth in range(len(levels), -1, -1):
        # pairs of nodes of the same two trees, each once
        width = widths[depth]
        distinct, place = np.unique((row * width + x) * width + y, return_inverse=True)
        back.append(place)
        y, rest = distinct % width, distinct // width
        row, x = rest // width, rest % width
        if depth:
            left, right = levels[depth - 1]
            row, x, y = np.concatenate([row, row]), np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]])
    own, price = shares(values, divisors[a]), np.zeros(len(row), np.int64)
    for r in range(len(others)):
        at = row == r
        price[at] = np.abs(own[x[at]] - shares(values, divisors[others[r]])[y[at]])
    n = len(price)
    for place in back[:0:-1]:
        price = price[place]
        price = price[: len(price) // 2] + price[len(price) // 2 :]
        n += len(price)
    return price[back[0]], n


def block_prices(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """Prices of one block of a language between the sources of two tiles."""
    lang, _, i, j = key
    heads = g[g.term == ""].sort_values("source", kind="stable")
    names, tile, divisors = heads.source.tolist(), heads.tile.to_numpy(), [int(d) for d in heads.divisor]
    cells = g[g.term != ""]
    terms = np.unique(cells.term.to_numpy(str)) if len(cells) else np.zeros(0, str)
    counts = np.zeros((len(names), 1 << max(0, int(np.ceil(np.log2(max(1, len(terms))))))), np.int64)
    counts[:, len(terms) :] = -1
    cells = cells[cells.source.notna()]
    if len(cells):
        counts[pd.Index(names).get_indexer(cells.source), np.searchsorted(terms, cells.term.to_numpy(str))] = cells.n.to_numpy()
    tree, out = consed(counts), []
    for a in range(len(names)):
        others = np.arange(a + 1, len(names)) if i == j else np.flatnonzero(tile == j) if tile[a] == i else np.zeros(0, np.int64)
        if len(others):
            out.append(pd.DataFrame({"lang": lang, "source": names[a], "item": [names[b] for b in others], "value": priced(tree, a, others, divisors)[0]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []}, dtype=object)


def met(rows: DataFrame, small: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` with what ``small`` has for their keys: a key of many rows is dealt to ``SALTS`` tasks."""
    some = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(some, [*keys, "salt"]).drop("salt")


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for the groups (lang, source) of ``docs``.

    Part ``pair``: how far the source is from each other source of its language, all ranks. Part ``term``: the terms that
    are more frequent in it than in its language, the first ``top``. Ranks go by falling value, then by the item's UTF-8.
    Null lang, source and text are read as ''. A term is in as many documents as rows have it, repeated rows each.
    Groups without terms have pairs; a language without kept terms gives pairs of value 0, and one of a single source
    gives none. Very long texts are read whole, in slices of words. Other columns are ignored; an empty table gives no rows.

    Counts are added up in the tasks that read the texts. Tables of groups are spread over ``SALTS`` tasks for joins, so
    neither a language nor a source is one task.
    """
    plain = lambda c: F.coalesce(c, F.lit(""))
    raw = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").cast("binary").alias("text")).mapInArrow(counted, "lang string, source string, term string, docs long, n long")
    by_source = raw.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    # a term's list has a row a source
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = stored(by_term.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"))
    langs = kept.groupBy("lang").agg(F.sum("all_n").alias("lang_total"), F.count_if(F.col("term") != "").alias("terms"), F.max(F.when(F.col("term") == "", F.size("by"))).alias("sources"))
    each = kept.select("lang", "term", "all_n", F.inline("by"))
    groups = each.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang")
    many = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    groups = groups.withColumns({"blocks": many(F.col("terms"), BLOCK), "tiles": many(F.col("sources"), TILE), "divisor": F.col("total") + PRIOR * F.col("terms")})
    groups = stored(groups.withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")))
    cells = met(each.where("term <> '' AND n > 0"), groups, ["lang", "source"], "term")

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all_n"), F.col("lang_total"), F.col("terms"))
    above = cells.where(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))

    rows = cells.withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("term", F.lit("")).withColumn("n", F.lit(0).cast("long"))
    columns = ["lang", "block", "source", "tile", "tiles", "divisor", "term", "n"]
    placed = rows.select(columns).unionAll(heads.select(columns)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "source", "tile", "divisor", "term", "n")
    # two tiles may both lack a term, which counts all the same
    tiled = groups.where("tiles > 1").groupBy("lang").agg(F.max("blocks").alias("blocks"), F.max("tiles").alias("tiles"))
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.transform(F.sequence(i, F.col("tiles") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    lacking = met(kept.where("term <> ''").select("lang", "term"), tiled, ["lang"], "term").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), F.inline(places), F.lit(None).cast("string").alias("source"), F.lit(0).alias("tile"), F.lit(0).cast("long").alias("divisor"), "term", F.lit(0).cast("long").alias("n"))
    placed = placed.unionAll(lacking)
    half = placed.groupBy("lang", "block", "i", "j").applyInPandas(block_prices, "lang string, source string, item string, value long")
    half = stored(half.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pairs = half.unionAll(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    numbered = lambda x: x.withColumn("rank", F.row_number().over(order).cast("int"))
    return numbered(pairs).unionAll(numbered(above).where(F.col("rank") <= top))
