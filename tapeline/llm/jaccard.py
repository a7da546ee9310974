"""N-gram Jaccard join: near-copies by rare-first prefixes of their shingle sets.

1. Every document becomes a set of 64-bit shingle hashes with a digest; documents of equal sets are one *text* from
   here on. The same pass counts shingles in a sketch of fixed size, summed over all documents.
2. Each set is ordered rare-first by that sketch (any fixed order is exact, a good one is fast), and its prefix of
   ``n - ceil(t n) + COMMON`` shingles is emitted. Texts that reach the threshold share ``COMMON`` shingles of these
   prefixes, or all that they must share if that is less.
3. Among the texts of a prefix shingle, pairs must pass the length and the positional filter, and be met that often. First each text meets
   one pivot of its shingle and size band; what the verified links connect already need not meet again, so groups of
   copies cost a number of pairs in proportion to their texts. All other pairs follow, those that pass.
   There each text has a bitmap, the parity of its shingles in 256 ranges of the hash: two bitmaps differ in no more
   places than their sets do, which most of the pairs that aren't links fail.
4. Pairs are made distinct, pass the suffix filter (counts of both sets over 64 ranges of the hash bound the
   overlap), and are verified once, on the whole sets. Connected components of the links give the classes.

Hashes of 64 bits stand for shingles; that two of a pair's collide is as likely as 1 in 10^4 at 10^8 shingles, and such a
shingle moves one overlap by one. Sets go by digests of 64 bits, which are checked by a second one of as many over all
documents: different sets of one digest get digests of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, stored
from .words import chunks, mixed, shingles, word_hashes

SHINGLE = 4
PERCENT = 85
#: Counters of the sketch, as a power of two, and the counters of a row of it.
SKETCH_BITS, ROW_BITS = 21, 15
BINS = 64
#: Longs of the bitmap that a text carries in the round of all pairs.
BITMAP = 4
#: Shingles of their prefixes that two texts must share.
COMMON = 6
#: Rounds in which texts meet a pivot only, before all pairs that are left.
PIVOT_ROUNDS = 2
#: Up to this many texts, their keys are broadcast to fetch their documents or sets; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Parts into which the rows of one text or class are dealt in joins.
SALTS = 32
#: Copies that a task remembers so as not to emit their prefixes again.
REMEMBERED = 1_000_000


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent digests of a set."""
    sums = [mixed(s ^ np.uint64(k)).sum(dtype=np.uint64) + np.uint64(len(s)) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    one, two = mixed(np.array(sums, np.uint64)).view(np.int64).tolist()
    return one, two


def digest(s: np.ndarray, renamed: dict[tuple[int, int], int]) -> int:
    """The first digest of a set, or what it is called where other sets have that too."""
    if not renamed:
        return int(mixed(np.array([mixed(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])
    both = digests(s)
    return renamed.get(both, both[0])


def rename(signed: DataFrame) -> dict[tuple[int, int], int]:
    """New digests for all sets but one of those that share a first one: a few of 10^11 sets."""
    shared = signed.where("fp IS NOT NULL").groupBy("fp").agg(F.min("fp2").alias("low"), F.max("fp2").alias("high")).where("low <> high")
    found = signed.join(shared.select("fp", "low"), "fp").where("fp2 <> low").select("fp", "fp2").distinct().collect()
    return {(r["fp"], r["fp2"]): int(mixed(np.array([r["fp"] ^ r["fp2"]], np.int64).view(np.uint64)).view(np.int64)[0]) for r in found}


def sets(texts, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, _, data, offs in chunks(texts):
        yield from enumerate(shingles(*word_hashes(data, offs), size), i)


def signatures(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, dict[tuple[int, int], int]]:
    """((doc_id, text_key, n, fp) of each row, partial rows of the sketch, renamed digests)."""

    names = ["doc_id", "text_key", "n", "fp", "fp2", "row", "counts"]

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            ns, fps, seconds, waiting, held = [], [], [], [], 0
            for _, s in sets(b.column(2), size):
                ns.append(len(s))
                one, two = digests(s) if len(s) else (None, None)
                fps.append(one)
                seconds.append(two)
                waiting.append(s >> np.uint64(64 - SKETCH_BITS))
                held += len(s)
                if held > 1 << 18:
                    np.add(sketch, np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(sketch)), out=sketch)
                    waiting, held = [], 0
            if held:
                np.add(sketch, np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(sketch)), out=sketch)
            none = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ns, pa.int64()), pa.array(fps, pa.int64()), pa.array(seconds, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        rows = np.minimum(sketch, 65535).astype("<u2").reshape(-1, 1 << ROW_BITS)
        used = np.flatnonzero(rows.any(1))
        none = pa.nulls(len(used)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(used, pa.int32()), pa.array([rows[k].tobytes() for k in used], pa.binary())], names=names)

    both = stored(keyed(docs).mapInArrow(run, "doc_id long, text_key long, n long, fp long, fp2 long, row int, counts binary"))
    signed, parts = both.where("row IS NULL").select("doc_id", "text_key", "n", "fp", "fp2"), both.where("row IS NOT NULL").select("row", "counts")
    renamed = rename(signed)
    for (one, two), new in renamed.items():
        signed = signed.withColumn("fp", F.when((F.col("fp") == one) & (F.col("fp2") == two), new).otherwise(F.col("fp")))
    return signed.drop("fp2"), parts, renamed


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def summed(parts: DataFrame) -> np.ndarray:
    """The sketch, of fixed size whatever the corpus: rows are added up by the tasks that get them."""

    def run(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = np.frombuffer(c.as_buffer(), "<u2").astype(np.int64)
                got[k] = got[k] + c if k in got else c
        for k, c in got.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array([k], pa.int32()), "counts": pa.array([np.minimum(c, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros((1 << (SKETCH_BITS - ROW_BITS), 1 << ROW_BITS), np.uint32)
    for k, c in parts.repartition("row").mapInArrow(run, "row int, counts binary").collect():
        out[k] = np.frombuffer(c, "<u4")
    return out.ravel()


def postings(docs: DataFrame, sketch: np.ndarray, size: int, percent: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """(h, fp, n, pos): the prefix of each set. A task emits the prefix of equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counts, seen = shared.value, set()
        for b in batches:
            hs, fps, ns, ps = [], [], [], []
            for _, s in sets(b.column(2), size):
                n = len(s)
                if not n or (fp := digest(s, renamed)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(fp)
                p = min(n, n - (percent * n + 99) // 100 + COMMON)
                c = counts[s >> np.uint64(64 - SKETCH_BITS)]
                order = np.lexsort((s, c))[:p]
                hs.append(s[order].view(np.int64))
                fps.append(np.full(p, fp))
                ns.append(np.full(p, n))
                ps.append(np.arange(p))
                if len(hs) >= 2000:
                    yield pa.RecordBatch.from_pydict({"h": np.concatenate(hs), "fp": np.concatenate(fps), "n": np.concatenate(ns).astype(np.int32), "pos": np.concatenate(ps).astype(np.int32)})
                    hs, fps, ns, ps = [], [], [], []
            if hs:
                yield pa.RecordBatch.from_pydict({"h": np.concatenate(hs), "fp": np.concatenate(fps), "n": np.concatenate(ns).astype(np.int32), "pos": np.concatenate(ps).astype(np.int32)})

    return keyed(docs).mapInArrow(run, "h long, fp long, n int, pos int")


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Overlap with which 100 * intersection >= percent * union."""
    return F.ceil((na + nb) * percent / F.lit(100.0 + percent) - 1e-9)


def plausible(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for two postings of a shingle, structs of (n, fp, pos, rank)."""
    na, nb, pa_, pb = (F.col(x).cast("long") for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    length = (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
    # the pair's common shingles before this one are in both prefixes, so neither text has more of them than its rank;
    # the k-th leaves room for all but k - 1: COMMON of them pass
    before = F.least(F.lit(COMMON - 1), F.col(f"{a}.rank"), F.col(f"{b}.rank"))
    return length & (F.least(na - pa_, nb - pb) + before >= needed(na, nb, percent))


def near_bitmaps(a: str, b: str, percent: int) -> Column:
    """Whether two texts, structs with (n, bitmap), may be as near as ``percent``: the sets differ in at least as many
    shingles as their bitmaps in places."""
    na, nb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    places = sum((F.bit_count(F.get(f"{a}.bitmap", F.lit(k)).bitwiseXOR(F.get(f"{b}.bitmap", F.lit(k)))) for k in range(BITMAP)), F.lit(0))
    return places <= na + nb - 2 * needed(na, nb, percent)


def ordered_pairs(rows: DataFrame, a: str, b: str, percent: int) -> DataFrame:
    """Distinct (a, b, na, nb) with a < b from structs of (n, fp, pos, rank), of those that come often enough. What rows
    there are holds each common shingle of a pair once."""
    one, two = F.least(F.struct(f"{a}.fp", f"{a}.n"), F.struct(f"{b}.fp", f"{b}.n")), F.greatest(F.struct(f"{a}.fp", f"{a}.n"), F.struct(f"{b}.fp", f"{b}.n"))
    return rows.select(one.alias("x"), two.alias("y")).groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).agg(F.first("x.n").alias("na"), F.first("y.n").alias("nb"), F.count("*").alias("common")).where(
        F.col("common") >= F.least(F.lit(COMMON), needed(F.col("na").cast("long"), F.col("nb").cast("long"), percent))).drop("common")


def kept_sets(docs: DataFrame, signed: DataFrame, texts: DataFrame, size: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """(fp, bitmap, bins, hashes) of the texts wanted, from one document of each."""
    first = signed.join(texts, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("d")).select("d.*")

    def run(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(maps, pa.list_(pa.int64())), pa.array(bins, pa.binary()), pa.array(hashes, pa.binary())], names=["fp", "bitmap", "bins", "hashes"])

        fps, maps, bins, hashes = [], [], [], []
        for b in batches:
            for _, s in sets(b.column(2), size):
                fps.append(digest(s, renamed))
                parity = np.bincount((s >> np.uint64(48) & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
                maps.append(np.packbits(parity.astype(np.uint8)).view("<i8").tolist())
                bins.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS), 65535).astype("<u2").tobytes())
                hashes.append(s.tobytes())
                if len(fps) >= 1000:
                    yield out()
                    fps, maps, bins, hashes = [], [], [], []
        if fps:
            yield out()

    rows, first = keyed(docs), stored(first.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")))
    wanted = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    met = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["text_key"] == F.col("_t")), "left_semi")
    # rows that repeat both doc_id and text give one set
    again = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("doc_id"))
    return stored(met.withColumn("_again", again).where("_again = 1").drop("_again").mapInArrow(run, "fp long, bitmap array<long>, bins binary, hashes binary"))


def verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""

    def bounded(batches):
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            x = np.frombuffer(b"".join(b.column(4).to_pylist()), "<u2").reshape(-1, BINS).astype(np.int64)
            y = np.frombuffer(b"".join(b.column(5).to_pylist()), "<u2").reshape(-1, BINS).astype(np.int64)
            most = np.minimum(x, y).sum(1)
            most[(x.max(1, initial=0) == 65535) | (y.max(1, initial=0) == 65535)] = 1 << 40
            ok = 100 * most >= percent * (na.astype(np.int64) + nb - most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    def exact(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def with_both(rows: DataFrame, column: str) -> DataFrame:
        for end in ("a", "b"):
            rows = rows.join(known.select(F.col("fp").alias(end), F.col(column).alias(f"{column}_{end}")), end)
        return rows

    passed = stored(with_both(pairs, "bins").select("a", "b", "na", "nb", "bins_a", "bins_b").mapInArrow(bounded, "a long, b long"))
    # whole sets are shuffled for these pairs only
    ends = passed.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    if ends.count() <= BROADCAST_ROWS:
        known = known.join(F.broadcast(ends), "fp", "left_semi")
    return stored(with_both(passed, "hashes").select("a", "b", "hashes_a", "hashes_b").mapInArrow(exact, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(fp, class): connected components of links (a, b), by the smallest fp.

    Labels go down to the smallest of the neighbours, are handed to the texts they name, and are followed by one
    step more, so the rounds grow with the logarithm of a chain. Each round is joins and partial aggregates.
    """
    both = stored(links.union(links.select("b", "a")).distinct())
    label = stored(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.first("a"), F.min("b")).alias("f")))
    before = None
    while True:
        now = label.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
        if now == before:  # labels never rise
            return label.withColumnRenamed("f", "class")
        before = now
        lowest = both.join(label.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("f").alias("m"))
        joined = label.join(lowest, "fp").withColumn("f2", F.least("f", "m"))
        hooked = joined.select("fp", "f2").union(joined.select("f", "f2")).groupBy("fp").agg(F.min("f2").alias("f"))
        hooked = stored(hooked)
        label = stored(hooked.join(hooked.select(F.col("fp").alias("f"), F.col("f").alias("g")), "f").select("fp", F.col("g").alias("f")))


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_key, n, fp) of each row of ``docs``, (fp, class) of the texts with links)."""
    signed, parts, renamed = signatures(docs, size)
    texts = Window.partitionBy("h")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    met = postings(docs, summed(parts), size, percent, renamed).withColumn("_first", F.min("fp").over(texts)).withColumn("_last", F.max("fp").over(texts)).where("_first <> _last")
    # a task may have emitted a text that another had too
    met = met.select("h", "n", "fp", "pos").dropDuplicates(["h", "fp"])
    # rank: shingles before it in the text's prefix that some other text has in its own; shared: all of them
    prefix = Window.partitionBy("fp")
    met = met.withColumn("rank", F.row_number().over(prefix.orderBy("pos")) - 1).withColumn("shared", F.count("*").over(prefix))
    # only texts that share enough of their prefix with others, whoever they are
    enough = F.col("shared") >= F.least(F.lit(COMMON), F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9))
    met = stored(met.where(enough).select("h", F.struct("n", "fp", "pos", "rank").alias("x"), band.alias("band"), "shared"))
    known = kept_sets(docs, signed, met.select("x.fp").distinct(), size, renamed)
    open_ = met.withColumn("class", F.col("x.fp"))
    links = tried = None
    for i in range(PIVOT_ROUNDS + 1):
        if i < PIVOT_ROUNDS:
            # the same few texts are pivots of all their shingles: first those at the centre of their group, which share
            # the most, then any
            lead = F.min(F.struct((-F.col("shared") if i == 0 else F.lit(0)).alias("c"), F.xxhash64("x.fp", F.lit(i)).alias("o"), "x", "class")).over(Window.partitionBy("h", "band"))
            rows = open_.withColumn("lead", lead).where(F.col("class") != F.col("lead.class")).select("x", F.col("lead.x").alias("y"))
        else:
            mapped = open_.withColumn("fp", F.col("x.fp")).join(known.select("fp", "bitmap"), "fp").select("h", "class", F.struct("x.n", "x.fp", "x.pos", "x.rank", "bitmap").alias("x"))
            other = mapped.select("h", F.col("x").alias("y"), F.col("class").alias("class_y"))
            rows = mapped.join(other, "h").where((F.col("class") < F.col("class_y")) & near_bitmaps("x", "y", percent))
        pairs = ordered_pairs(rows.where(plausible("x", "y", percent)), "x", "y", percent)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = verified(pairs, known, percent)
        links, tried = (found, pairs.select("a", "b")) if links is None else (links.union(found), tried.union(pairs.select("a", "b")))
        classes = components(links)
        if i < PIVOT_ROUNDS:
            # shingles of texts that aren't connected yet
            classed = open_.drop("class").withColumn("fp", F.col("x.fp")).join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp")).drop("fp")
            open_ = stored(classed.withColumn("_low", F.min("class").over(texts)).withColumn("_high", F.max("class").over(texts)).where("_low <> _high").drop("_low", "_high"))
    return signed, classes


def salted(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined with ``small``, which has one row for each key: a key of many rows is dealt to ``SALTS`` tasks."""
    some = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int")).join(some, [key, "salt"], "left").drop("salt")


def classed(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, fp, class) of each row that has a set."""
    return salted(signed.where("fp IS NOT NULL"), classes, "fp").withColumn("class", F.coalesce("class", "fp"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    A text that is null or without words has no shingles and is linked with nothing, not even its like. Equal sets
    are linked. A row without doc_id takes part, and names no component; alone, its component is null. Rows of one
    doc_id are compared as documents of their own. Very long texts are compared whole. An empty table gives no rows.
    Other columns are ignored.
    """
    signed, classes = linked(docs, size, percent)
    found = stored(classed(signed, classes))
    # a row alone in its class is its own component
    names = found.groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    named = salted(found, names, "class").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
    return named.union(signed.where("fp IS NULL").select("doc_id", "n", "doc_id"))


def apply_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: that of its smallest doc_id. Texts without words stay. Of rows
    that repeat that doc_id those of the smallest text digest stay; rows without doc_id stay where alone. Other columns
    may have any name; an empty table gives no rows."""
    signed, classes = linked(docs, size, percent)
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")
    keep = classed(signed, classes).groupBy("class").agg(F.min(first).alias("d")).select("d.doc_id", "d.text_key").union(signed.where("fp IS NULL").select("doc_id", "text_key")).distinct()
    doc, key = free(docs, "doc", "key")
    keep = keep.toDF(doc, key)
    return docs.join(keep, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_semi")
