"""Bloom dedup, R-tree negatives and the source audit against plain Python, on odd rows and on the smallest tables."""

import hashlib
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import audit, bloom, rtree

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(6000))
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "Alpha beta", "en", "a"), (9, "ALPHA Beta", "en", "b"), (9, "alpha beta", "de", "b"), (9, "alpha beta", "de", "b"), (None, "alpha beta", None, "a"),
    (None, "only nulls", "en", None), (None, "ONLY nulls", "en", None), (4, "Ärger", "de", "c"), (5, "ärger", "de", "c"), (6, LONG, "fr", "c"), (7, LONG.upper(), "fr", "d"), (8, "one", "", ""), (10, "12 345 \n\t !!", "xx", "z"),
]


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, b"x", 2, 3) for r in ODD], "doc_id long, text string, lang string, source string, row long, sha binary, h long, n int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[lowered(r["text"])].append(i)
    out = []
    for t, places in groups.items():
        keep = max(places, key=lambda i: (rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, -i))
        out += [(rows[i]["doc_id"], rows[keep]["doc_id"], len(places), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in places]
    return sorted(map(str, out))


def test_exact_dedup(odd, docs):
    for df in (odd, docs, odd.limit(0)):
        assert sorted(str(tuple(r)) for r in bloom.exact_dedup(df).collect()) == brute_dedup(df.collect())


def test_apply_exact_dedup(odd, docs):
    for df in (odd, docs):
        kept = bloom.apply_exact_dedup(df)
        assert kept.schema == df.schema
        want = {(x[0], x[-1]) for x in map(eval, brute_dedup(df.collect())) if x[3]}
        got = [(r["doc_id"], hashlib.sha256(lowered(r["text"]).encode()).hexdigest()) for r in kept.collect()]
        assert len(got) == len(want) and set(got) == want


def test_filter_finds_all_repeats_and_few_others(spark):
    rng = np.random.default_rng(3)
    alone, twice = rng.integers(-(2**63), 2**63, 20000), rng.integers(-(2**63), 2**63, 300)
    hashes = spark.createDataFrame([(int(h),) for h in np.concatenate([alone, twice, twice, np.full(5000, 7)])], "h long").repartition(5)
    bits = bloom.filled(hashes, 25600)
    assert bits.both(np.append(twice, 7)).all()
    assert bits.both(alone).mean() < 0.03
    small = bloom.Bits(bits.power, bits.segments)  # too few cells: more is taken for repeated, and nothing is missed
    assert small.both(twice).all()


def test_overfull_filter_changes_nothing(docs, monkeypatch):
    monkeypatch.setattr(bloom, "MOST", 13)
    monkeypatch.setattr(bloom, "LEAST", 3)
    monkeypatch.setattr(bloom, "CELLS_A_ROW", 1)
    assert sorted(str(tuple(r)) for r in bloom.exact_dedup(docs).collect()) == brute_dedup(docs.collect())


# ---- hard negatives


def brute_negatives(rows, every=100, npos=5, nneg=10):
    valid = [(i, r["vec_id"], r["label"], np.floor(256 * np.array(r["embedding"], float)).astype(object)) for i, r in enumerate(rows) if r["vec_id"] is not None and r["label"] is not None and r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    out = []
    for i, a, label, q in valid:
        if a % every:
            continue
        near = [(-(int((q * v).sum()) if len(v) else 0), b, lb) for j, b, lb, v in valid if j != i and len(v) == len(q)]
        for p, pid, _ in sorted((x for x in near if x[2] == label), key=lambda x: x[:2])[:npos]:
            hard = sorted(x[:2] for x in near if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:nneg]
            out += [(a, pid, k, n, -p, -s) for k, (s, n) in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(map(tuple, rtree.hard_negatives(rows, label).collect()))
    assert got and got == brute_negatives(rows.withColumn("label", label).collect())


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(rtree, "LEAF", 2)
    monkeypatch.setattr(rtree, "FAN", 2)
    monkeypatch.setattr(rtree, "BLOCK", 60)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0.2, 1, 3).round(2)], int(rng.integers(0, 3))) for i in range(60)]
    rows += [(100, [0.0, 0.0, 0.0], 1), (100, [0.5, 0.5, 0.5], 1), (100, [0.5, 0.5, 0.5], 2), (200, [], 0), (201, [], 1), (202, [], 0), (None, [1.0, 1.0, 1.0], 1), (300, None, 1), (400, [1.0, None, 0.0], 1), (500, [float("nan"), 0.0, 0.0], 1)]
    rows += [(600, [1.0, 1.0], None), (700, [float("inf"), 1.0], 1), (800, [1.0, 2.0], 1), (801, [1.0, 2.0], 1), (802, [1.0, 1.0], 2), (803, [-1.0, -1.0], 2)] + [(900 + i, [0.3, 0.3, 0.3], 2) for i in range(30)]
    df = spark.createDataFrame([(i, e, la, 1, 2) for i, e, la in rows], "vec_id long, embedding array<double>, label int, key int, v int").repartition(3)
    got = sorted(map(tuple, rtree.hard_negatives(df, F.col("label")).collect()))
    assert got and got == brute_negatives(df.collect())
    assert rtree.hard_negatives(df.limit(0), F.col("label")).collect() == []


def test_boxes_prune_and_lose_nothing():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (20, 6))
    v = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 6))).astype(np.int64)
    labels, ids = rng.integers(0, 3, 4000), np.arange(4000)
    tree = rtree.Tree.read(*rtree.Tree.of(ids, ids, labels, v).row())
    total = 0
    for a in range(0, 4000, 400):
        for window in ((-(10**9), 10**9), (1000, 50000), (-20000, -1)):
            ids_, scores, opened = tree.best(a, v[a], int(labels[a]), False, window, 10)
            s = v @ v[a]
            ok = np.flatnonzero((labels != labels[a]) & (s >= window[0]) & (s <= window[1]))
            want = ok[np.lexsort((ok, -s[ok]))[:10]]
            assert ids_.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
            total += opened
    assert total / 30 < sum(len(x[0]) for x in tree.levels) / 3


def test_queries_side_by_side(monkeypatch):
    """Many queries at once give what each gives alone, with windows that are open, narrow, empty or lacking, and in a
    small part of the time, as a node meets its queries in one product."""
    rng = np.random.default_rng(2)
    v = rng.integers(-256, 257, (6000, 64))
    v[1000:1040] = v[7]
    labels, ids, keys = rng.integers(0, 3, 6000), rng.permutation(6000), np.arange(6000)
    tree = rtree.Tree.read(*rtree.Tree.of(keys, ids, labels, v).row())
    asked = np.arange(0, 6000, 30)
    low = np.stack([np.full(200, rtree.ANY[0]), np.full(200, -90_000), np.full(200, rtree.ANY[1])], 1)
    high = np.stack([np.full(200, rtree.ANY[1]), np.full(200, 70_000), np.full(200, rtree.ANY[0])], 1)
    for same in (True, False):
        start = time.process_time()
        (who, n, got, scores), _ = tree.search(asked, v[asked], labels[asked], same, low, high, 10)
        together, start = time.process_time() - start, time.process_time()
        alone = {(i, w): tree.best(a, v[a], int(labels[a]), same, (int(low[i, w]), int(high[i, w])), 10) for i, a in enumerate(asked) for w in range(2)}
        assert together < (time.process_time() - start) / 4
        for (i, w), (ids_, scores_, _) in alone.items():
            s = v @ v[asked[i]]
            ok = np.flatnonzero(((labels == labels[asked[i]]) == same) & (keys != asked[i]) & (s >= low[i, w]) & (s <= high[i, w]))
            want = ok[np.lexsort((ids[ok], -s[ok]))[:10]]
            at = (who == i) & (n == w)
            assert ids_.tolist() == got[at].tolist() == ids[want].tolist() and scores_.tolist() == scores[at].tolist() == s[want].tolist()
        assert set(n) == {0, 1}
    # some queries beyond what floats hold exactly, and few bounds at once
    monkeypatch.setattr(rtree, "BOUNDS", 1)
    wide = v[asked[:9]] * np.where(np.arange(9) % 2, 1 << 40, 1)[:, None] + 1
    (who, n, got, scores), _ = tree.search(asked[:9], wide, labels[asked[:9]], True, low[:9, :1], high[:9, :1], 4)
    for i in range(9):
        s = v @ wide[i]
        ok = np.flatnonzero((labels == labels[asked[i]]) & (keys != asked[i]))
        want = ok[np.lexsort((ids[ok], -s[ok]))[:4]]
        assert got[who == i].tolist() == ids[want].tolist() and scores[who == i].tolist() == s[want].tolist()


def test_equal_vectors_found_are_bounded():
    """Many queries that find thousands of equal scores hold few of them at once, and get those of the smallest ids."""
    rng = np.random.default_rng(3)
    v = np.repeat(rng.integers(-40, 40, (4, 64)), 4096, axis=0)
    labels, ids, keys = np.repeat(np.arange(4), 4096), rng.permutation(len(v)), np.arange(len(v))
    tree = rtree.Tree.of(keys, ids, labels, v)
    q, low, high = np.repeat(v[::4096][:3].sum(0)[None], 256, axis=0), np.zeros((256, 5), np.int64), np.full((256, 5), 10**9)
    tracemalloc.start()
    (who, n, got, scores), _ = tree.search(np.full(256, -1), q, np.zeros(256, np.int64), False, low, high, 10)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    s = v @ q[0]
    ok = np.flatnonzero((labels != 0) & (s >= 0))
    want = ok[np.lexsort((ids[ok], -s[ok]))[:10]]
    assert len(who) == 256 * 5 * 10 and (got.reshape(-1, 10) == ids[want]).all() and (scores.reshape(-1, 10) == s[want]).all()
    assert peak < 100e6, peak


def test_queries_are_copied_to_few_parts(spark):
    """Queries go to no more parts than there are blocks, nor to more than the rows outweigh, and their copies, which
    Spark takes for as small as the queries, aren't broadcast."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    valid = rtree.quantised(rows, "vec_id", "embedding", F.col("label"), 256)
    index = rtree.indexed(valid, 64 * valid.count())
    asked = valid.where("id % 100 = 0").withColumn("windows", F.array(F.struct(F.lit(rtree.ANY[0]).alias("low"), F.lit(rtree.ANY[1]).alias("high"))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        blocks, cores = index.count(), spark.sparkContext.defaultParallelism
        assert rtree.copies(index, 5, 500) == blocks <= cores and rtree.copies(index.limit(0), 0, 0) == 1
        many = index.crossJoin(spark.range(1000))
        assert rtree.copies(many, 5, 500) == 25 and rtree.copies(many, 500, 500) == cores and rtree.copies(many, 1, 5000) == 300
        found = rtree.searched(index, asked, 2, blocks, True, 5)
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_vectors_in_few_blocks(spark):
    """Many partitions of few vectors don't give each query rows from as many blocks."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    asked = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    for k, x in asked.items():
        spark.conf.set(k, x)
    try:
        valid = rtree.quantised(rows, "vec_id", "embedding", F.col("label"), 256)
        assert rtree.indexed(valid, 64 * valid.count()).count() <= spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, rtree.hard_negatives(rows, F.col("label")).collect())) == brute_negatives(rows.collect())
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


# ---- source audit


def brute_audit(rows, min_docs, top=50):
    words = [(r["lang"] or "", r["source"] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r["text"]))) for r in rows]
    out = []
    for lang in {w[0] for w in words}:
        mine = [w for w in words if w[0] == lang]
        df = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        whole = set(kept)
        count = {s: Counter(t for _, s2, ts in mine if s2 == s for t in ts if t in whole) for s in {w[1] for w in mine}}
        count[None] = sum(count.values(), Counter())
        p = {s: [1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept] for s, c in count.items()}
        for s in p.keys() - {None}:
            pairs = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode(), o) for o in p.keys() - {None, s})
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((y - x, t.encode(), t) for t, x, y in zip(kept, p[s], p[None], strict=True) if count[s][t] and x > y)
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def test_source_audit(odd, docs, monkeypatch):
    for df, least in ((docs, 30), (docs, 3), (odd, 1), (odd, 2), (odd.limit(0), 1)):
        assert sorted(map(tuple, audit.source_audit(df, least).collect())) == brute_audit(df.collect(), least)
    monkeypatch.setattr(audit, "BLOCK", 16)
    monkeypatch.setattr(audit, "TILE", 3)
    assert sorted(map(tuple, audit.source_audit(docs, 3).collect())) == brute_audit(docs.collect(), 3)


def test_tasks_put_out_in_parts(docs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(audit, "ENTRIES", 50)
    monkeypatch.setattr(audit, "WORDS", 7)
    b = pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a", "a", "b"], "text": [LONG.encode(), b"word1 Word1 x9", b""]})
    docs_, n = Counter(), Counter()
    for part in audit.counted([b]):
        for _, source, term, d, k in zip(*(c.to_pylist() for c in part.columns), strict=True):
            docs_[source, term] += d
            n[source, term] += k
    assert n["a", "word"] == 6002 and docs_["a", "word"] == 2 and docs_["a", "x"] == 1 and ("b", "") in n


def test_equal_subtrees_are_one_node_and_priced_once():
    counts = np.zeros((3, 1024), np.int64)
    counts[1, 5], counts[2, 700:704] = 9, 2
    values, levels, roots = tree = audit.consed(counts)
    assert sum(len(x) for x, _ in levels) < 40 and len(set(roots.tolist())) == 3
    divisors = [5 * 1024 + int(n) for n in counts.sum(1)]
    got, met = audit.priced(tree, 0, np.array([1, 2]), divisors)
    p = [audit.shares(c, d) for c, d in zip(counts, divisors, strict=True)]
    assert got.tolist() == [int(np.abs(p[0] - p[b]).sum()) for b in (1, 2)] and met < 100
    big = np.array([10**13, 3, -1])
    assert audit.shares(big, 10**14).tolist() == [1 + 10**9 * (10**13 + 5) // 10**14, 1 + 10**9 * 8 // 10**14, 0]
