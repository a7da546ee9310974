"""Language identification as inference of a mixture.

Each language is a distribution over hashed three-byte n-grams, counted over all documents to learn from. A
document's n-grams are drawn from a mixture of languages, whose proportions expectation-maximisation estimates.
Sets of languages, grown in order of proportion, compete by likelihood less a penalty for each language; they grow
until no larger set can pay its penalty, by a bound on the likelihood of all mixtures. The model has 256 KB for each
language, and a run of texts as many distinct n-grams as memory holds for all languages, one text at least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks

BUCKETS = 1 << 16
ROUNDS = 12
#: Probabilities (n-grams of documents times languages) that are held at once.
CELLS = 1 << 20
#: Bytes of texts whose n-grams are taken at once.
RUN = 1 << 19
PENALTY = 6.0
NONE = "und"
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each n-gram that lies within a row and isn't all spaces."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _CLASS[data]
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    ok = (row[:-2] == row[2:]) & (code != 0x202020)
    code, row = code[ok], row[:-2][ok]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), row


def learn(docs: DataFrame, use: Column) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [bucket, language]) from text and lang of the documents for which ``use`` holds."""
    some = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs = sorted(r[0] for r in some.select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(langs)}

    def count(batches):
        for b in batches:
            lang = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            for i, j, data, offs in chunks(b.column(1), RUN):
                code, row = grams(data, offs)
                here, of = np.unique(lang[i:j], return_inverse=True)
                key = of[row] * BUCKETS + code
                if len(here) <= 64:
                    n = np.bincount(key, minlength=1)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:  # only what is there
                    key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_pydict({"k": pa.array(here[key // BUCKETS], pa.int32()), "g": pa.array(key % BUCKETS, pa.int32()), "n": n.astype(np.int64)})

    # the n-grams that each language has, summed on the map side first
    counts = np.full((BUCKETS, len(langs)), 0.5)
    if langs:
        rows = some.mapInArrow(count, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toArrow()
        counts[rows["g"].to_numpy(), rows["k"].to_numpy()] += rows["n"].to_numpy()
    counts /= counts.sum(0)
    return langs, np.log(counts, out=counts).astype(np.float32)


def mixture(p: np.ndarray, n: np.ndarray, doc: np.ndarray, docs: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions [doc, language], log-likelihood, its bound over all mixtures) by EM from equal shares of the allowed
    languages. The bound holds for the concave likelihood: what it gains toward any language is at most its slope.
    p: probability of each distinct n-gram of a document in each language; n: how often; doc: whose, ascending."""
    share = allowed / allowed.sum(1, keepdims=True)
    starts = np.searchsorted(doc, np.arange(docs))
    total = np.add.reduceat(n, starts)
    for _ in range(ROUNDS):
        joint = p * share[doc]
        joint *= (n / joint.sum(1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    mix = (p * share[doc]).sum(1)
    ll = np.add.reduceat(n * np.log(mix), starts)
    return share, ll, ll + np.add.reduceat(p * (n / mix)[:, None], starts, axis=0).max(1) - total


def judge(log_p: np.ndarray, code: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language or -1, score, shares of the chosen set) for each row."""
    best, score, chosen = np.full(rows, -1), np.zeros(rows), np.zeros((rows, log_p.shape[1]))
    if not len(code) or not log_p.shape[1]:
        return best, score, chosen
    key, n = np.unique(row * BUCKETS + code, return_counts=True)
    ends = np.searchsorted(key, np.arange(rows + 1) * BUCKETS)
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CELLS // log_p.shape[1], "right")) - 1)
        if ends[j] > ends[i]:
            judge_run(log_p, key[ends[i] : ends[j]], n[ends[i] : ends[j]], best, score, chosen)
        i = j
    return best, score, chosen


def judge_run(log_p: np.ndarray, key: np.ndarray, n: np.ndarray, best: np.ndarray, score: np.ndarray, chosen: np.ndarray) -> None:
    """Fills in the rows of ``key``, the distinct n-grams by row."""
    of, there = np.unique(key // BUCKETS, return_inverse=True)
    lp = log_p[key % BUCKETS].astype(np.float64)
    top = lp.max(1)
    p, d, m = np.exp(lp - top[:, None]), len(of), n.astype(float)  # a factor common to all languages changes nothing
    share, _, bound = mixture(p, m, there, d, np.ones((d, log_p.shape[1])))
    starts = np.searchsorted(there, np.arange(d))
    single = np.add.reduceat((lp - top[:, None]) * m[:, None], starts, axis=0)
    penalty = PENALTY * np.log(np.add.reduceat(m, starts) + 1)
    first = single.argmax(1)
    kept, gain = np.zeros((d, log_p.shape[1])), single[np.arange(d), first]
    kept[np.arange(d), first] = 1.0
    order = np.argsort(-share, axis=1, kind="stable")
    for size in range(2, log_p.shape[1] + 1):
        # documents for which a set of so many languages may still pay
        again = np.flatnonzero(bound - (size - 1) * penalty > gain)
        if not len(again):
            break
        mask = np.zeros((d, log_p.shape[1]))
        np.put_along_axis(mask, order[:, :size], 1.0, axis=1)
        inside = np.isin(there, again)
        s, ll, _ = mixture(p[inside], m[inside], np.searchsorted(again, there[inside]), len(again), mask[again])
        ll -= (size - 1) * penalty[again]
        better = ll > gain[again]
        kept[again[better]], gain[again[better]] = s[better], ll[better]
    best[of], chosen[of] = kept.argmax(1), kept
    score[of] = np.clip(np.where((kept > 0).sum(1) == 1, share[np.arange(d), first], kept.max(1)), 0, 1)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``doc_id``, lang_pred, score, languages and shares for each row of ``docs``, from its whole text alone.

    A text that is null or has no letter gives ``und`` with score 0; a text too short for an n-gram gives the first
    language with an even score. Without any learned language all are ``und``. Equal rows are judged alike.
    """
    langs, log_p = model
    shared = docs.sparkSession.sparkContext.broadcast(log_p)

    def run(batches):
        table = shared.value
        for b in batches:
            texts = b.column(1)
            for i, j, data, offs in chunks(texts, RUN):
                best, score, chosen = judge(table, *grams(data, offs), j - i)
                pred, sets, shares = [], [], []
                for r in range(j - i):
                    raw = bytes(data[offs[r] : offs[r + 1]])
                    if not langs or not has_letter(raw.decode("utf-8", "replace")):
                        best[r], score[r] = -1, 0.0
                    elif best[r] < 0:
                        best[r], score[r], chosen[r] = 0, 1 / len(langs), 1 / len(langs)
                    k = np.flatnonzero(chosen[r] > 0) if best[r] >= 0 else []
                    pred.append(langs[best[r]] if best[r] >= 0 else NONE)
                    sets.append([langs[x] for x in k])
                    shares.append([float(chosen[r, x]) for x in k])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "languages", "shares"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def language_id(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, languages, shares.
    A row without doc_id is not held out, and nothing is learned from it."""
    model = learn(docs, F.coalesce(remainder(F.col("doc_id")) != 2, F.lit(False)))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "shares")


def apply_language_id(docs: DataFrame, min_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is found with ``min_score`` at least, as they are; texts that are null,
    without letters, or of no clear language go."""
    langs, log_p = learn(docs, F.coalesce(remainder(F.col("doc_id")) != 2, F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(log_p)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for i, j, data, offs in chunks(b.column(at), RUN):
                best, score, _ = judge(shared.value, *grams(data, offs), j - i)
                good = [k for k in range(i, j) if langs and best[k - i] >= 0 and score[k - i] >= min_score and has_letter(bytes(data[offs[k - i] : offs[k - i + 1]]).decode("utf-8", "replace"))]
                yield b.take(pa.array(good, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
