"""The operators against the contracts in plain Python: on odd rows and on the smallest tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import divergence, jaccard, langid, lines, mixing, network, packing, quality, scoring, sharding, topk
from tapeline.llm.queries import tokenizer_path
from tapeline.llm.words import word_hashes

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, h long"
LONG = " ".join(f"word{i % 977}" for i in range(6000))
SHARED = "a line that is surely longer than twenty characters"
ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "de", "b"), (4, "one", "en", "a"), (5, "one two three", "en", "a"), (5, "one two three", "en", "a"),
    (None, "the lazy dog and the quick fox " * 12, "en", None), (6, LONG, "fr", "c"), (7, LONG + " end", None, "c"), (8, f"{SHARED}\nx\n{SHARED.upper()}  ", "en", "b"),
    (9, f" {SHARED}\ny", "en", "b"), (10, f"{SHARED}\n", "en", "b"), (10, f"{SHARED}\nz", "en", "b"), (11, "12345 678 !!!", "en", "a"), (12, "Straße élan naïve <|endoftext|> don't", "de", "a"),
]
ODD = [(d, t, la, s, None, None, None, None) for d, t, la, s in ODD]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


def plain(df):
    return [{"doc_id": r["doc_id"], "text": r["text"]} for r in df.collect()]


def test_line_dedup(odd, docs, rows):
    for df, expected in ((odd, plain(odd)), (docs, rows)):
        got = sorted(map(str, (tuple(r) for r in lines.line_dedup(df).collect())))
        assert got == sorted(str(x[:4]) for x in brute.line_dedup(expected))


def test_near_duplicates(odd, docs, rows):
    for df, expected in ((odd, plain(odd)), (docs, rows)):
        found = brute.near(expected)
        groups = {}
        for r, (_, c) in zip(expected, found, strict=True):
            groups.setdefault(c, []).append(r["doc_id"])
        want = [(r["doc_id"], n, min((i for i in groups[c] if i is not None), default=None)) for r, (n, c) in zip(expected, found, strict=True)]
        assert sorted(map(str, map(tuple, jaccard.near_duplicates(df).collect()))) == sorted(map(str, want))


def test_base_rules(odd, docs, rows):
    for df, expected in ((odd, plain(odd)), (docs, rows)):
        got = divergence.quality_rules(df).collect()
        assert sorted(str((r["doc_id"], *r[1:7])) for r in got) == sorted(str((x["doc_id"], *brute.base_rules(x["text"]))) for x in expected)
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_divergence_keeps_clean_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    got = divergence.quality_rules(docs).join(labels, "doc_id").where("NOT base_failed")
    assert got.count() > 50 and got.where("NOT kept").count() == 0


def test_mix(odd, docs):
    for df in (odd, docs):
        got = mixing.mix(df).collect()
        assert len(got) == df.count()
        sizes = {}
        for r in got:
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        goal, taken = brute.targets(sizes), {}
        for r in got:
            assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], goal[r["source"]], abs_tol=1e-6)
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 3 * mixing.MIN_BLOCK for s in goal)
        assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    assert mixing.apply_mix(docs).columns == docs.columns


def test_minimax_cuts():
    for seed in range(120):
        rng = random.Random(seed)
        sizes, n = [rng.choice([1, 3, rng.randint(8, 200)]) for _ in range(rng.randint(1, 50))], rng.randint(1, 8)
        groups = list(zip(sorted(f"{rng.getrandbits(64):016x}" for _ in sizes), sizes, strict=True))

        def sums(items, width):
            out = {}
            for d, s in items:
                out.setdefault(d[:width], []).append(s)
            return [(p, sum(v), max(v), len(v)) for p, v in out.items()]

        nodes = sums(groups, 1)
        while opened := (cuts := sharding.Cuts(nodes, n)).undecided():
            nodes = [x for x in nodes if x[0] not in opened] + [y for p in opened for y in sums([g for g in groups if g[0].startswith(p)], len(p) + 1)]
        ends = cuts.cut()
        total = [0] * n
        for d, s in groups:
            total[sum((d > e + "g") if e else 1 for e in ends)] += s
        assert max(total) == brute.minimax(sizes, n)


def test_shards(odd, docs):
    for df in (odd, docs):
        got = sharding.shards(df).collect()
        assert len(got) == df.count()
        slots, text, where = {}, {}, {}
        for r in df.collect():
            data = (r["text"] or "").encode()
            text.setdefault((r["doc_id"], len(data) + 8, brute.crc(data)), set()).add(r["text"])
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
            for t in text[(r["doc_id"], r["size"], r["text_crc32"])]:
                where.setdefault(t, set()).add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())


def test_packing(odd, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for df in (odd, docs):
        want, got, seqs = [], [], {}
        for r in df.collect():
            want.append((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)))
        pieces = packing.pack(df.coalesce(1), tokenizer_path(), with_ids=True).collect()
        open_ = {}
        for p in sorted(pieces, key=lambda p: (str(p["doc_id"]), p["start"])):
            ids = np.frombuffer(p["ids"], "<u4")
            assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
            seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
            open_.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], tuple(map(int, ids))))
        for (doc, n), parts in open_.items():
            twins = [w for w in want if w[0] == doc and len(w[1]) == n]
            assert sum(len(x) for _, x in parts) == n * len(twins)
            for start, x in parts:
                assert any(w[1][start : start + len(x)] == x for w in twins)
            got += twins
        assert sorted(map(str, got)) == sorted(map(str, want))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= packing.LENGTH and len(parts) <= packing.MAX_SEGMENTS and (at & (at - 1)) == 0


def test_packing_limits(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "tok " * rng.randint(1, 90), rng.randint(0, 40)) for i in range(300)], "doc_id long, text string, prompt long")
    got = packing.pack(df.coalesce(1), tokenizer_path(), length=64, segments=3, loss=32, prompt_tokens="prompt").collect()
    prompt = {r["doc_id"]: r["prompt"] for r in df.collect()}
    seqs = {}
    for p in got:
        seqs.setdefault(p["sequence_id"], []).append((p["length"], max(0, p["start"] + p["length"] - max(p["start"], prompt[p["doc_id"]]))))
    assert all(sum(a for a, _ in s) <= 64 and len(s) <= 3 and sum(b for _, b in s) <= 32 for s in seqs.values())
    assert sum(p["length"] for p in got) == sum(p["doc_tokens"] for p in got if p["start"] == 0)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vs = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    vs += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [1.0, 2.0]), (450, vs[3][1]), (500, vs[3][1]), (None, vs[0][1]), (7, vs[7][1]), (9, []), (50, [])]
    # ids that repeat with other vectors, queries among them
    vs += [(50, vs[51][1]), (1, [3.0] * 8), (1, [0.5] * 8), (100, vs[100][1]), (404, [0.0] * 8), (550, [0.0] * 8), (551, [1e9] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in vs], "vec_id long, embedding array<float>, score long, id int, key int")
    known = [{"vec_id": r["vec_id"], "embedding": r["embedding"]} for r in df.collect()]
    assert sorted(tuple(r) for r in topk.top_k(df.repartition(3)).collect()) == brute.top_k(known)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert sorted(tuple(r) for r in topk.top_k(table).collect()) == brute.top_k([r.asDict() for r in table.collect()])


def test_top_k_reads_less_than_all():
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    table = table[table.embedding.map(lambda x: x is not None and np.isfinite(np.array(x, float)).all())]
    v, ids = np.floor(256 * np.stack(table.embedding.to_list()).astype(float)).astype(np.int64), table.vec_id.to_numpy()
    block = topk.Block.read(v.shape[1], *topk.Block.of(np.arange(len(v)), ids, v).row())
    read = 0
    for i in np.flatnonzero(ids % 50 == 0):
        at, scores, n = block.best(i, v[i], 5)
        exact = v @ v[i]
        exact[i] = -(10**9)
        best = np.lexsort((ids, -exact))[:5]
        read += n
        assert (scores == exact[best]).all() and (ids[at] == ids[best]).all()
    assert read < 0.9 * (ids % 50 == 0).sum() * v.size


def test_language(odd, docs):
    got = {(r["doc_id"]): r for r in langid.language_id(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert sum(got[d]["lang_pred"] == lang[d] for d in held) >= 0.95 * len(held)
    odd_rows = langid.language_id(odd).collect()
    assert len(odd_rows) == len(ODD) and all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 11)) for r in odd_rows if r["doc_id"] != 11)
    assert langid.apply_language_id(docs).columns == docs.columns


def test_language_mixture():
    rng = np.random.default_rng(0)
    log_p = np.log(np.array([[0.7, 0.1], [0.1, 0.7], [0.2, 0.2]], np.float32))
    code = rng.choice(3, 400, p=[0.4, 0.4, 0.2])
    _, _, chosen = langid.judge(log_p, code, np.zeros(400, np.int64), 1)
    assert (chosen[0] > 0.3).all()
    best, score, chosen = langid.judge(log_p, rng.choice(3, 400, p=[0.7, 0.1, 0.2]), np.zeros(400, np.int64), 1)
    assert best[0] == 0 and score[0] > 0.9 and (chosen[0] > 0).sum() == 1


def plain_log_p(words, text, net, tokens, spell, windows, trust):
    """Of one text, place by place: windows maps four neighbours and a word's place in them to the words seen there."""
    t = brute.words((text or "").translate(brute.LOWER))
    ids = [tokens.size + 1] * 2 + [words.get(w, tokens.size) for w in t] + [tokens.size + 1] * 2
    total = 0.0
    for i, w in enumerate(t):
        h = np.tanh(sum(net.e[k * (tokens.size + 2) + ids[i + 2 + s]].astype(float) for k, s in enumerate(network.PLACES)) + net.b)
        c = ids[i + 2] // network.WIDE if ids[i + 2] < tokens.size else net.classes
        z = net.u @ h + net.c
        total += z[c] - np.log(np.exp(z - z.max()).sum()) - z.max()
        if ids[i + 2] < tokens.size:
            z = net.uw[c] @ h + net.cw[c]
            total += z[ids[i + 2] % network.WIDE] - np.log(np.exp(z - z.max()).sum()) - z.max()
            continue
        data = np.frombuffer(w.encode(), np.uint8)
        p = spell.log_p(data, np.array([0]), np.array([len(data)]))[0]
        seen = windows[tuple(t[i + s] if 0 <= i + s < len(t) else None for s in network.PLACES)]
        total += math.log((1 - trust) * math.exp(p) + trust) if len(seen) > 1 and len(set(seen)) == 1 else p
    return len(t), total


def test_pseudo_likelihood(docs, spark):
    """Every word of the scores, computed place by place in plain Python from the same weights."""
    from collections import defaultdict

    docs = docs.limit(60).union(docs.limit(5))
    rows = docs.collect()
    counts = scoring.word_counts(docs)
    known, n = scoring.vocabulary(counts, 150)
    total = counts.agg(F.sum("n")).first()[0]
    (weights, spelled), memory = scoring.train(docs, known, n, total), scoring.memory(docs, known)
    trust = scoring.agreement(memory)
    got = scoring.score(docs, known, weights, spelled, memory, trust).collect()
    tokens, net, spell = scoring.Tokens(known), network.Network(150, weights), network.Spelling(spelled)
    every = {w for r in rows for w in brute.words((r["text"] or "").translate(brute.LOWER))}
    token = {w: int(tokens.of(word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0])[0]) for w in every}
    words, windows = {w: k for w, k in token.items() if k < tokens.size}, defaultdict(list)
    for r in rows:
        t = brute.words((r["text"] or "").translate(brute.LOWER))
        for i, w in enumerate(t):
            if w not in words:
                windows[tuple(t[i + s] if 0 <= i + s < len(t) else None for s in network.PLACES)].append(w)
    want = sorted((r["doc_id"], *plain_log_p(words, r["text"], net, tokens, spell, windows, trust)) for r in rows)
    assert len(words) == 150 and len(got) == len(want)
    for (d, k, lp), r in zip(want, sorted(got, key=lambda r: (r["doc_id"], r["log_likelihood"])), strict=True):
        assert (d, k) == (r["doc_id"], r["n_tokens"]) and math.isclose(lp, r["log_likelihood"], rel_tol=1e-4, abs_tol=1e-2)


def test_pseudo_likelihood_does_not_depend_on_partitions(odd, docs):
    for df in (docs, odd):
        one, many = ({str((r["doc_id"], r["n_tokens"], round(r["log_likelihood"], 2))) for r in scoring.pseudo_likelihood(df.repartition(n)).collect()} for n in (1, 16))
        assert one == many
    assert all(r["n_tokens"] == 0 and r["mean_log_p"] is None and r["log_likelihood"] == 0 for r in scoring.pseudo_likelihood(odd).collect() if r["doc_id"] in (1, 2, 3))


def test_pseudo_likelihood_of_held_out_documents(spark):
    """Trained on most documents, the network predicts the words of the others better than their frequencies do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").dropDuplicates(["text"])
    learned, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    counts = scoring.word_counts(learned)
    known, n = scoring.vocabulary(counts)
    total = counts.agg(F.sum("n")).first()[0]
    start = network.Network(len(known))
    start.start_from(np.array(n, float), total - sum(n))
    weights, tokens = scoring.train(learned, known, n, total)[0], scoring.Tokens(known)
    before = after = places = 0
    for r in held.collect():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        h, bounds = word_hashes(data, np.array([0, len(data)]))
        before += scoring.network_log_p(start, tokens.of(h), bounds).sum()
        after += scoring.network_log_p(network.Network(len(known), weights), tokens.of(h), bounds).sum()
        places += len(h)
    print("held-out log-probability a token:", before / places, "by frequency,", after / places, "by the network")
    assert after / places > before / places + 0.3


def test_quality(odd, docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.hierarchical(docs, labels, F.col("source"), F.col("lang"))
    truth = got.join(labels.select("doc_id", F.col("quality").alias("truth")), "doc_id")
    assert got.count() == docs.count() and truth.where((F.col("truth") == 1) != F.col("kept")).count() <= 0.05 * truth.count()
    clash = odd.withColumn("label", F.lit(1)).withColumn("host", F.lit(2)).withColumn("evidence", F.lit(3)).withColumn("counted", F.lit("x"))
    for some in (labels, labels.limit(0), spark.createDataFrame([(5, None, 0), (5, 1, 0), (5, 0, 0), (None, 1, 1), (4, 0, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")):
        rows = quality.hierarchical(clash, some, F.col("source"), F.lit(None)).collect()
        assert len(rows) == len(ODD) and all(0 <= r["quality"] <= 1 and 0 <= r["site"] <= 1 for r in rows)


def test_quality_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.hierarchical(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 2 = 0"), F.col("source"), F.col("lang"))
    rows = got.join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("truth")), "doc_id").collect()
    assert sum((r["truth"] == 1) == r["kept"] for r in rows) >= 0.95 * len(rows) > 100


def test_site_posteriors(spark):
    """Against plain Python; a document between bad neighbours is rejected and its like between good ones is kept."""
    rng = random.Random(3)
    rows = [(i, f"h{i % 3}", f"p{i % 7 // 3}", rng.choice([0.02, 0.4, 0.97]), None) for i in range(80)] + [(100, "h0", "lone", 0.3, None), (101, "sparse", "x", 0.6, None)]
    rows += [(200 + i, "good", "a", 0.99, None) for i in range(40)] + [(300 + i, "bad", "a", 0.01, None) for i in range(40)] + [(400, "good", "a", 0.45, None), (401, "bad", "a", 0.55, None)]
    rows = [(i, h, p, e, (float(i % 2) if i % 5 == 0 else e)) for i, h, p, e, _ in rows]
    got = {r["doc_id"]: r for r in quality.shrunk(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double, counted double")).collect()}
    for (i, *_), (site, q) in zip(rows, brute.site_posteriors([r[1:] for r in rows]), strict=True):
        assert math.isclose(got[i]["site"], site, rel_tol=1e-9) and math.isclose(got[i]["quality"], q, rel_tol=1e-9) and got[i]["kept"] == (q >= 0.5)
    assert got[400]["kept"] and not got[401]["kept"] and got[400]["evidence"] < 0.5 < got[401]["evidence"]


def test_site_of(spark):
    row = spark.createDataFrame([("https://Blog.x.example/en/853/?a#b",), ("http://x.example",), (None,), ("no url",)], "url string").select(*quality.site_of(F.col("url"))).collect()
    assert [tuple(r) for r in row] == [("blog.x.example", "en"), ("x.example", None), (None, None), (None, None)]


def test_divergence_distances(odd, docs):
    """Distances and verdicts as plain Python has them."""
    for df in (odd, docs):
        rows = [r.asDict() for r in df.select("doc_id", "text", "lang").collect()]
        want = []
        for r, (char, word) in zip(rows, brute.divergence(rows), strict=True):
            n, _, _, _, _, failed = brute.base_rules(r["text"])
            limit = divergence.MAX_WORD_DISTANCE + divergence.WORD_NOISE / math.sqrt(max(1, n))
            char = char if len((r["text"] or "").encode()) >= divergence.MIN_CHARS else 0
            want.append((r["doc_id"], not failed and char <= divergence.MAX_CHAR_DISTANCE and word <= limit))
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["kept"])) for r in divergence.quality_rules(df).collect())


def test_windows_of_one_hash(spark, monkeypatch):
    """Repeats are found between windows of other words with their hash."""
    monkeypatch.setattr(divergence.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    text = " ".join(["a b c x y", "d e f x y a b c", "q r s d e f t u", "v w"] * 1)
    row = spark.createDataFrame([(text,)], "text string").select(divergence.repeated_words(divergence.split_words(F.col("text"))).alias("n")).first()
    assert row["n"] == brute.base_rules(text)[4] > 0


def test_mixture_by_em():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(9), 3).T
    code = rng.integers(0, 9, 300)
    from collections import Counter

    counts = Counter(code.tolist())
    grams = np.array(sorted(counts))
    share, _, _ = langid.mixture(p[grams], np.array([counts[g] for g in grams], float), np.zeros(len(grams), int), 1, np.ones((1, 3)))
    assert np.allclose(share[0], brute.mixture(p.tolist(), counts), atol=1e-9)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 100


def test_schedule_is_balanced_at_every_prefix(spark):
    sizes, goals = [4000, 900, 16000], [9000, 2700, 5000]
    slots = sorted(mixing.schedule(spark, sizes, goals).collect(), key=lambda r: r["slot"])
    need, seen = [0] * 3, [0] * 3
    for r in slots:
        need[r["src"]] += 1
    for i, r in enumerate(slots, 1):
        seen[r["src"]] += 1
        assert all(abs(seen[k] - need[k] * i / len(slots)) <= 4 for k in range(3))


def test_mix_slots(spark, docs):
    rows = mixing.mix(docs).collect()
    assert all((r["slot"] is None) == (r["taken"] == 0) for r in rows) and len({r["source"] for r in sorted(rows, key=lambda r: (r["slot"] is None, r["slot"]))[:60]}) >= 8
    got = mixing.apply_mix(docs, ordered=True)
    assert got.columns == docs.columns and got.count() == mixing.apply_mix(docs).count()


def test_shards_are_near_equal(spark):
    """On all documents of a table: the largest shard is the smallest possible, found by trying out every cut."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r["text"] for r in docs.select("text").collect()]
    got = sharding.shards(docs).collect()
    total, groups = {}, {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    import hashlib

    for t in rows:
        key = hashlib.md5(t.encode() if t is not None else b"null text").hexdigest()
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 8
    sizes = [n for _, n in sorted(groups.items())]
    assert max(sizes) < sum(sizes) / 24  # else a group has a shard of its own, apart from the order
    assert max(total.values()) == brute.minimax(sizes, 24) and len(total) == 24 and min(total.values()) > 0.7 * sum(sizes) / 24


def test_packing_with_another_tokenizer(spark, docs):
    """A file with other splits gives its own ids, from whole texts."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[UNK]": 0, "the": 5, "The": 6, "of": 7}, unk_token="[UNK]"))
    other.normalizer, other.pre_tokenizer = normalizers.NFC(), pre_tokenizers.Whitespace()
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        f.write(other.to_str())
        f.flush()
        assert not packing.by_words(other) and packing.by_words(Tokenizer.from_file(tokenizer_path()))
        some = docs.limit(20)
        ids = {}
        for p in sorted(packing.pack(some.coalesce(1), f.name, with_ids=True).collect(), key=lambda p: p["start"]):
            ids[p["doc_id"]] = ids.get(p["doc_id"], b"") + bytes(p["ids"])
        for r in some.collect():
            assert np.frombuffer(ids[r["doc_id"]], "<u4").tolist() == [*other.encode(r["text"] or "", add_special_tokens=False).ids, 1]


CLASH = ("drop", "row_key", "doc", "key", "_doc", "_key", "_size", "size", "words", "times", "slot", "copy", "copies", "_copies", "salt", "fp", "class", "n", "h", "window", "label", "cell", "round", "tokens", "pos", "hash")


@pytest.mark.parametrize("stage", [langid.apply_language_id, lines.apply_line_dedup, jaccard.apply_near_duplicates, mixing.apply_mix])
def test_stages_on_odd_rows(spark, stage):
    """Columns of any name stay as they are, odd rows don't stop a stage, and an empty table stays empty."""
    df = spark.createDataFrame([r[:5] for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    got = stage(df)
    assert got.columns == df.columns
    known = {str(r["doc_id"]): r for r in df.collect()}
    rows = got.collect()
    assert rows and all(r[c] == known[str(r["doc_id"])][c] for r in rows for c in CLASH)
    assert stage(df.limit(0)).collect() == []


def test_packing_on_clashing_columns(spark):
    df = spark.createDataFrame([r[:5] for r in ODD], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(1).alias(c) for c in ("n", "start", "length", "ids", "offset")])
    assert packing.pack(df, tokenizer_path()).where("start = 0").count() == len(ODD)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = [lines.line_dedup(none), jaccard.near_duplicates(none), divergence.quality_rules(none), mixing.mix(none), sharding.shards(none), packing.pack(none, tokenizer_path()), langid.language_id(none), scoring.pseudo_likelihood(none), quality.hierarchical(none, labels, F.col("source"), F.col("lang")), topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"))]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as c

    first = c.language(spark, docs, SF)
    clean = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()]
    kept = {r["doc_id"] for r in first.collect()}
    assert set(clean) <= kept
    second = c.line_dedup(spark, docs, SF)
    want = {x[0]: x[4] for x in brute.line_dedup(rows)}
    assert {r["doc_id"]: r["text"] for r in second.collect()} == want
    third = c.near_duplicates(spark, docs, SF)
    groups = {}
    for r, (n, k) in zip(rows, brute.near(rows, 5, 80), strict=True):
        groups.setdefault(k, []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(map(min, groups.values()))
    assert all(x.columns == docs.columns for x in (first, second, third))
    out = c.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_pipeline_batches(spark, docs):
    """Python tasks of the stages get a thousand rows at once at most, or as few as the session asks for; the rows that come out are the same."""
    import corpus_pipeline as c
    import pyarrow as pa

    def largest(batches):
        yield pa.RecordBatch.from_pydict({"n": [max(len(b) for b in batches)]})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    count = docs.count()
    many = docs.crossJoin(spark.range(2500 // count + 1).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + F.col("k") * 1_000_000).drop("k").coalesce(1)
    plain = {"language": langid.apply_language_id, "pack": lambda d: packing.pack(d, tokenizer_path())}
    try:
        spark.conf.set(key, 10_000)
        want = {name: sorted(map(tuple, f(many).collect())) for name, f in plain.items()}
        assert spark.range(0, 2500, 1, 1).mapInArrow(largest, "n long").first()[0] == 2500
        for name in ("language", "near_duplicates", "pack"):
            for asked, most in ((10_000, 1000), (0, 1000), (300, 300)):
                spark.conf.set(key, asked)
                out = getattr(c, name)(spark, docs if name == "near_duplicates" else many, SF)
                assert spark.range(0, 2500, 1, 1).mapInArrow(largest, "n long").first()[0] == most
                assert name not in want or sorted(map(tuple, out.collect())) == want[name]
    finally:
        spark.conf.set(key, before)


def test_sets_of_one_digest(spark):
    """Different sets whose first digests are equal are told apart by the second."""
    import pyarrow as pa

    rows = spark.createDataFrame([(1, 11), (1, 11), (1, 12), (2, 13), (1, 14), (None, None)], "fp long, fp2 long")
    found = jaccard.rename(rows)
    assert set(found) == {(1, 12), (1, 14)} and len({1, 2, *found.values()}) == 4
    (_, one), (_, other) = jaccard.sets(pa.array(["a b c d e f", "a b c d e g"]), 4)
    first, second = jaccard.digests(one)
    assert jaccard.digest(one, {}) == first and jaccard.digest(one, {(first, second): 5}) == 5 and jaccard.digest(one, {(first, second + 1): 5}) == first
    assert jaccard.digests(other) != (first, second) and jaccard.digests(np.zeros(0, np.uint64)) != (first, second)
