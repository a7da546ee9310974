"""Each operator does the whole job: no cap on words, languages, sets or sizes that the input can outgrow."""

import math
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapeline.llm import divergence, jaccard, langid, mixing, network, packing, scoring
from tapeline.llm.queries import tokenizer_path
from tapeline.llm.words import word_hashes

from . import brute


def test_every_token_trains(spark):
    """A corpus of short texts trains the network, and each token is a target once."""
    docs = spark.createDataFrame([(i, "red green blue") for i in range(4000)], "doc_id long, text string")
    counts = scoring.word_counts(docs)
    words, n = scoring.vocabulary(counts)
    cells = scoring.cells(docs, words, 12000).where("cell >= 0").collect()
    assert sum(len(c["tokens"]) // 2 for c in cells) == 12000 == sum(int(np.frombuffer(c["bounds"], "<i8")[-1]) for c in cells) and {c["round"] for c in cells} == set(range(scoring.ROUNDS))
    start = network.Network(len(words))
    start.start_from(np.array(n, float), 0)
    token, bounds = scoring.Tokens(words).of(word_hashes(np.frombuffer(b"red green blue", np.uint8), np.array([0, 14]))[0]), np.array([0, 3])
    before, after = (scoring.network_log_p(network.Network(len(words), w), token, bounds).sum() for w in (start.flat, scoring.train(docs, words, n, 12000)[0]))
    assert after > before + 1


def test_probabilities_of_a_place_sum_to_one():
    rng = np.random.default_rng(0)
    net = network.Network(150)
    net.start_from(rng.integers(1, 90, 150).astype(float), 1000)
    around = rng.integers(0, 152, (1, 4))
    assert math.isclose(sum(math.exp(net.log_p(around, np.array([t]))[0]) for t in range(151)), 1, rel_tol=1e-4)
    # spellings of one letter, or of none of two letters that may follow it
    words = [b"ab", b"ba", b"a", b"b", b"aab"]
    data, at = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])
    spell = network.Spelling(network.spelling_counts(np.frombuffer(data, np.uint8), at[:-1], at[1:] - 1))

    def p(word):
        return math.exp(spell.log_p(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])

    letters = [bytes([c]) for c in range(256) if c not in b" \t\n\x0b\x0c\r" and not 65 <= c <= 90]
    longer = sum(math.exp(spell.after[(network._SYMBOL[x[0]]) * network.SYMBOLS + network._SYMBOL[y[0]]] + spell.byte[y[0]] + spell.after[network._SYMBOL[x[0]]] + spell.byte[x[0]]) for x in letters for y in letters)
    assert math.isclose(sum(map(p, letters)) + longer + math.exp(spell.after[0]), 1, rel_tol=1e-3) and p(b"ab") > 20 * p(b"zq")


def test_texts_without_common_words_are_rejected(spark):
    """Labelled junk that passes the base rules is rejected, whatever common words it has, and clean text is kept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = divergence.quality_rules(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    junk, clean = [r for r in got if r["quality"] == 0], [r for r in got if r["quality"] == 1]
    assert junk and sum(r["kept"] for r in junk) <= 0.05 * len(junk) and sum(r["kept"] for r in clean) >= 0.985 * len(clean)
    assert all(r["word_distance"] is not None for r in got) and not any(r["kept"] for r in junk if r["n_words"] >= 200)


def test_every_language_is_a_reference(spark):
    """A language of few documents, in a script of its own, is measured against itself however many others there are."""
    rows = [(k * 10 + i, " ".join(f"word{chr(97 + k)}{chr(97 + j % 26)}{j}" for j in range(i, i + 90)), f"l{k:02d}") for k in range(20) for i in range(3)]
    rows.append((999, " ".join("".join(chr(0x4E00 + (j * 7 + k * 31) % 5000) for k in range(6)) for j in range(90)), "zz"))
    got = {r["doc_id"]: r for r in divergence.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and got[999]["char_distance"] < 0.01 and got[999]["kept"]


def test_small_sources_meet_their_targets(spark):
    """Beside a source of 48 million words each source takes its target, to the word; blocks don't grow."""
    big = spark.range(48).selectExpr("id AS doc_id", "repeat('w ', 1000000) AS text", "'a' AS source")
    small = spark.createDataFrame([(100, "w " * 7, "b"), (101, "w " * 23, "b"), (102, "w", "c"), (103, "w " * 500, "d"), (104, None, "e"), (105, "w " * 17, None)], "doc_id long, text string, source string")
    got = mixing.mix(big.union(small)).collect()
    goal, taken = {r["source"]: r["target"] for r in got}, Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(got) == 54 and goal["d"] == 1500 and all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    slots = mixing.schedule(spark, [30, 1, 500], [90, 2, 777]).collect()
    assert [sum(r["words"] for r in slots if r["src"] == k) for k in range(3)] == [90, 2, 777] and len({r["slot"] for r in slots}) == len(slots)


def test_points_are_exact_at_any_slot(spark):
    """Every point once in M slots; at 10^12 slots and more the same as in whole numbers of any length."""
    p, m = mixing.lattice(1000)
    assert (p, m) == (987, 1597) and sorted(j * p % m for j in range(m)) == list(range(m))
    p, m = mixing.lattice(3 * 10**12)
    assert m >= 3 * 10**12 and m < 1.62 * 3 * 10**12
    ids = [0, 1, 10**9 + 7, 10**12, 10**12 + 1, m - 1]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing.point(F.col("id"), p, m).alias("at")).collect()
    assert {r["id"]: r["at"] for r in got} == {i: i * p % m for i in ids}


def test_ranks_count_slots_in_order(spark, monkeypatch):
    """Against counting slot by slot, with parts and groups of parts small enough that all three sums are met."""
    monkeypatch.setattr(mixing, "PART", 7)
    need = [300, 1, 0, 577]
    p, m = mixing.lattice(sum(need))
    seen, want = [0] * 4, set()
    bounds = [sum(need[: k + 1]) * m // sum(need) for k in range(4)]
    for j in range(m):
        k = sum(b <= j * p % m for b in bounds[:-1])
        if seen[k] < need[k]:
            want.add((j, k, seen[k]))
        seen[k] += 1
    got = [tuple(r) for r in mixing.ranked(spark, need).collect()]
    assert set(got) == want and len(got) == sum(need) and mixing.ranked(spark, [0, 0]).count() == 0


def test_taken_words_are_those_of_the_schedule(spark):
    """Slot by slot: what the slots take of each document's words, and the first of them, is what the mix says."""
    docs = spark.createDataFrame([(i, "w " * (i * 37 % 101), "abc"[i % 7 % 3]) for i in range(90)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    key = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", "text")).collect()}
    by_source = sorted({(r["source"], r["source_size"], r["target"]) for r in got.values()})
    slots = mixing.schedule(spark, [x[1] for x in by_source], [int(x[2] + 0.5) for x in by_source]).collect()
    for k, (name, size, _) in enumerate(by_source):
        stream = [r for r in sorted(got.values(), key=lambda r: (key[r["doc_id"]] % mixing.CELLS, key[r["doc_id"]])) if r["source"] == name for _ in range(r["size"])]
        assert len(stream) == size
        taken, first = Counter(), {}
        for s in sorted((s for s in slots if s["src"] == k), key=lambda s: s["slot"]):
            for r in stream[s["block"] * mixing.MIN_BLOCK :][: s["words"]]:
                taken[r["doc_id"]] += 1
                first.setdefault(r["doc_id"], s["slot"])
        assert all(r["taken"] == taken[r["doc_id"]] and r["slot"] == first.get(r["doc_id"]) for r in got.values() if r["source"] == name)


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    own = [["".join(rng.choice(letters, 6)) for _ in range(40)] for _ in range(70)]
    rows = [(k * 20 + i, " ".join(rng.choice(own[k], 120)), f"l{k:02d}") for k in range(70) for i in range(8 if k else 4)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and all(r["lang_pred"] == lang[r["doc_id"]] for r in got)


def test_sets_of_languages_grow_while_they_pay():
    rng = np.random.default_rng(0)
    p = np.full((6, 6), 0.04) + np.eye(6) * 0.76
    log_p = np.log(p).astype(np.float32)
    _, _, chosen = langid.judge(log_p, rng.choice(6, 4000, p=p[:5].mean(0)), np.zeros(4000, np.int64), 1)
    assert (chosen[0, :5] > 0.1).all() and chosen[0, 5] == 0
    # 1.5 % of a long text in a second language
    p = np.full((8, 2), 1e-4)
    p[:4, 0], p[4:, 1] = 0.25, 0.25
    p /= p.sum(0)
    _, _, chosen = langid.judge(np.log(p).astype(np.float32), rng.choice(8, 20000, p=p @ [0.985, 0.015]), np.zeros(20000, np.int64), 1)
    assert 0.01 < chosen[0, 1] < 0.02


def test_ids_of_many_texts(monkeypatch):
    """Texts encoded together have the tokenizer's ids, with every Latin-1 character, other ones, special tokens, long
    texts in parts and forgotten pieces, in less time than word by word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, rng = packing.Pieces(packing.Words(tokenizer)), np.random.default_rng(1)
    assert pieces.direct
    some = [chr(c) for c in range(256)]
    texts = ["", " ", "\n\n", "it's 'street'll''s ,'t 9'd d'", "x" * 300, "É'RE <|endoftext|> a", "œuvre ’s e\u0301 İ"] + some + [f"a{c}b {c}{c}1{c}" for c in some]
    texts += ["".join(rng.choice([*some, *"'' aAsStTrReEmMdDlLvV,. "] if n % 2 else [*"aAsStTrReEmMdDlLvV'' ,.1É"], 25)) for n in range(600)]
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for run, most in ((packing.RUN, packing.PIECES), (7, 5)):
        monkeypatch.setattr(packing, "RUN", run)
        monkeypatch.setattr(packing, "PIECES", most)
        assert [np.frombuffer(x, "<u4").tolist() for x in pieces.ids([x.encode() for x in texts])] == want
    monkeypatch.undo()
    words = [bytes(w) for w in rng.integers(97, 123, (20_000, 4), np.uint8)]
    texts = [b" ".join(w.capitalize() + b",.!*"[i % 5 : i % 5 + 1] for i, w in enumerate(words[k] for k in rng.integers(0, 20_000, 2000))) for _ in range(200)]
    took = []
    for encode in (packing.Pieces(packing.Words(tokenizer)).ids, lambda x, w=packing.Words(tokenizer): [w.ids(t) for t in x]):
        start = time.process_time()
        out = encode(texts)
        took.append((time.process_time() - start, out))
    assert took[0][1] == took[1][1] and took[0][0] < 0.8 * took[1][0], (took[0][0], took[1][0])


def test_memory_of_a_packing_task():
    """A word is remembered once, a long one never, and the ids are the tokenizer's."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    words = packing.Words(tokenizer)
    text = "Plain plain, (PLAIN)! naïve Été... don't a1 12 ### x|y " + "lengthy" * 30 + " İstanbul ÿß, e\u0301"
    assert list(np.frombuffer(words.ids(text.encode()), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids
    assert max(map(len, words)) <= packing.LONGEST and {b"plain", b"plain,", b"(PLAIN)!", b","} <= set(words)
    rng = np.random.default_rng(0)
    texts = [b" ".join(bytes(w) for w in rng.integers(97, 123, (1000, 8), np.uint8)) for _ in range(60)] + [rng.integers(97, 123, 20_000, np.uint8).tobytes() for _ in range(60)]
    tracemalloc.start()
    for t in texts:
        words.ids(t)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 11e6, held


def test_memory_of_shingles():
    """Texts are hashed a run at a time, whose arrays are a small part of a task's memory."""
    texts = pa.array(["some words of a text " * 100] * 3000)
    list(jaccard.sets(texts[:10], 5))
    tracemalloc.start()
    n = sum(1 for _ in jaccard.sets(texts, 5))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 3000 and peak < 25e6, peak


def test_windows_are_merged_before_they_are_sent(spark):
    """The memory holds each repeated window with its count and its one word, in any number of blocks, and rows of single
    windows aren't shuffled."""
    texts = ["a b c d e f", "a b c d e f", "a b x d e f", "p q r", "p q r", "", None, "lone words here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3 + ["seen once only"])], "doc_id long, text string")
    words = scoring.vocabulary(scoring.word_counts(docs), 4)[0]
    every = [x for *_, window, word in scoring.unknown(pa.array([r["text"] for r in docs.collect()]), scoring.Tokens(words)) for x in zip(window.tolist(), word.tolist(), strict=True)]
    n, held = Counter(w for w, _ in every), {}
    for w, x in every:
        held.setdefault(w, set()).add(x)
    want = sorted((w, held[w].copy().pop() if len(held[w]) == 1 else None, k) for w, k in n.items() if k > 1)
    assert any(x is None for _, x, _ in want) and any(k == 1 for k in n.values())
    for places in (0, len(every), 50 * scoring.BLOCK):
        known = scoring.memory(docs.repartition(5), words, places)
        assert sorted(map(tuple, known.collect())) == want and "HashAggregate" not in known._jdf.queryExecution().executedPlan().toString()


def test_records_are_merged_by_key():
    rng = np.random.default_rng(0)
    rows = np.zeros(5000, scoring.SEEN)
    rows["key"], rows["n"], rows["low"] = rng.integers(0, 900, 5000).astype(np.uint64) << np.uint64(54), 1, rng.integers(0, 99, 5000)
    rows["high"] = rows["low"]
    for most in (50, 10_000):
        parts = list(scoring.combined((rows[i : i + 70] for i in range(0, 5000, 70)), most))
        assert (len(parts) == 1) == (most > 900) and all((np.diff(p["key"].astype(float)) > 0).all() for p in parts)
        got = scoring.merged(parts)
        assert {k: (n, lo, hi) for k, n, lo, hi in got.tolist()} == {int(k): (int((m := rows["key"] == k).sum()), int(rows["low"][m].min()), int(rows["low"][m].max())) for k in np.unique(rows["key"])}
    assert not len(scoring.merged([rows[:0]])) and list(scoring.combined([], 5)) == []
