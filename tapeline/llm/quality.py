"""Quality by hierarchical empirical Bayes.

A logistic classifier of hashed words, word pairs and the form of the text, fitted to a bounded sample of labelled
documents, gives each document its own evidence: the odds that it is good, before anything is known of its site. Grouped
sums give posteriors of hosts, shrunk toward the global mean, and of paths, shrunk toward their host; a labelled document
counts in them by its label, any other by its evidence. How strongly sites are shrunk follows from the spread between
them beyond what chance gives (method of moments), so sparse sites stay near their host, and sparse hosts near the mean.
A document's odds move by the ratio of its path's odds to the global ones (Bayes' rule for a prior that its site knows
better), its own part in the site left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import chunks, mixed, word_spans

#: The classifier is fitted to the labelled documents of the smallest hashes, so many at most.
SAMPLE = 10_000
THRESHOLD = 0.5
#: Buckets of words and of word pairs, half of them each.
BUCKETS = 1 << 15
EPOCHS, BATCH, RATE, L2, RIDGE = 5, 128, 0.05, 1e-4, 1e-2
FORM = ("upper", "digit", "symbol", "mark", "bar", "wide", "word_length", "distinct_words", "log_length")
_KIND = np.full(256, 6, np.int64)
for _k, _letters in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "!?", "|")):
    _KIND[[ord(c) for c in _letters]] = _k
_KIND[128:] = 5


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, first segment of the path) of a URL, for tables that have one; null where there is none."""
    part = lambda k: F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)(?:/([^/?#]*))?", k), F.lit(""))
    return F.lower(part(1)), part(2)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(form [row, feature], row, bucket and weight of the hashed features there are, rows ascending)."""
    rows = len(offs) - 1
    hashes, bounds, _, _ = word_spans(data, offs)
    row = np.repeat(np.arange(rows), np.diff(offs))
    n_bytes, n_words = np.maximum(np.diff(offs), 1), np.diff(bounds)
    kinds = np.bincount(row * 7 + _KIND[data], minlength=rows * 7).reshape(rows, 7)[:, :6] / n_bytes[:, None]
    word_row = np.repeat(np.arange(rows), n_words)
    half = np.uint64(BUCKETS // 2)
    one = (hashes % half).astype(np.int64)
    inside = word_row[1:] == word_row[:-1]
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[inside]
    code = np.concatenate([word_row * BUCKETS + one, word_row[:-1][inside] * BUCKETS + BUCKETS // 2 + (pairs % half).astype(np.int64)])
    code, n = np.unique(code, return_counts=True)
    where = code // BUCKETS
    distinct = np.bincount(np.unique(np.stack([word_row, hashes.view(np.int64)]), axis=1)[0], minlength=rows) if len(hashes) else np.zeros(rows)
    some = np.maximum(n_words, 1)
    form = np.column_stack([kinds, np.minimum(n_bytes / some, 30) / 10, distinct / some, np.log1p(n_words) / 10])
    return form, where, code % BUCKETS, n / np.sqrt(some[where] * 2.0)


class Classifier:
    """Weights of the form, of a constant, and of the buckets."""

    def __init__(self, form: np.ndarray, constant: float, buckets: np.ndarray):
        self.form, self.constant, self.buckets = form, constant, buckets

    def log_odds(self, form, row, bucket, weight) -> np.ndarray:
        return form @ self.form + self.constant + np.bincount(row, weights=self.buckets[bucket] * weight, minlength=len(form))


def newton(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic model with a ridge."""
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(form: np.ndarray, ends: np.ndarray, bucket: np.ndarray, weight: np.ndarray, y: np.ndarray) -> Classifier:
    """The form's weights by Newton's method, then the buckets' by Adagrad on what the form leaves open, in a fixed order of
    the rows; ends: where each row's buckets end, after a 0. Without labels of both kinds, odds of the prior for all."""
    model = Classifier(np.zeros(form.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros(BUCKETS))
    if not len(y) or y.min() == y.max():
        return model
    w = newton(np.column_stack([form, np.ones(len(form))]), y)
    model.form, model.constant = w[:-1], float(w[-1])
    square, rng = np.full(BUCKETS, 1e-4), np.random.default_rng(0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            n = ends[at + 1] - ends[at]
            own = np.repeat(np.arange(len(at)), n)
            flat = np.repeat(ends[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            b, v = bucket[flat], weight[flat]
            slope = (1 / (1 + np.exp(-np.clip(model.log_odds(form[at], own, b, v), -30, 30))) - y[at]) / len(at)
            here, of = np.unique(b, return_inverse=True)
            grad = np.bincount(of, weights=v * slope[own]) + L2 * model.buckets[here]
            square[here] += grad * grad
            model.buckets[here] -= RATE * grad / np.sqrt(square[here])
    return model


def classifier(docs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fitted to at most ``sample`` rows of ``known`` (doc_id, label), which are few enough to be sent to all tasks, and
    whose features, some thousand numbers each at most, fit the driver."""
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def run(batches):
        for b in batches:
            for i, j, data, offs in chunks(b.column(3)):
                form, row, bucket, weight = features(data, offs)
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (bucket.astype(np.int16), weight.astype(np.float32))]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * form.shape[1]), pa.array(form.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), flat, *lists], names=["doc_id", "key", "label", "form", "bucket", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "key", "label", "text")
    got = rows.mapInArrow(run, "doc_id long, key long, label double, form array<float>, bucket array<short>, weight array<float>").toArrow()
    # rows that repeat a labelled doc_id count once
    order = np.lexsort((got["key"].to_numpy(), ids := got["doc_id"].to_numpy()))
    order = order[np.diff(ids[order], prepend=-(2**63)) != 0] if len(order) else order
    got = got.take(pa.array(order)).combine_chunks()
    if not got.num_rows:
        return fit(np.zeros((0, len(FORM))), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    column = lambda k: got.column(k).chunk(0)
    flat = lambda k: column(k).flatten().to_numpy(zero_copy_only=False)
    ends = column("bucket").offsets.to_numpy().astype(np.int64)
    return fit(flat("form").reshape(got.num_rows, -1).astype(float), ends - ends[0], flat("bucket"), flat("weight"), (column("label").to_numpy() > 0).astype(float))


def evidence(docs: DataFrame, model: Classifier, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, evidence) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.form, model.constant, model.buckets))

    def run(batches):
        model = Classifier(*shared.value)
        for b in batches:
            for i, j, data, offs in chunks(b.column(3)):
                z = np.clip(model.log_odds(*features(data, offs)), -30, 30)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "host", "path", "evidence"])

    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(host).alias("host"), mark(path).alias("path"), "text")
    return rows.mapInArrow(run, "doc_id long, host string, path string, evidence double")


def strength(sites: DataFrame, n: str, s: str, center: Column, mean: float) -> float:
    """Pseudo-count of a prior: mean (1 - mean) over the variance of sites around their center beyond chance, less 1;
    at least 1, at most 1000."""
    row = sites.agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - center, 2)).alias("v"), F.sum(n).alias("n"), F.count("*").alias("sites")).first()
    if not row["n"]:
        return 1000.0
    chance = mean * (1 - mean)
    between = (row["v"] - chance * row["sites"]) / row["n"]
    return float(min(1000.0, max(1.0, chance / between - 1))) if between > 0 else 1000.0


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def shrunk(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, host, path, evidence, site, quality, kept) from (doc_id, host, path, evidence, counted): ``counted`` is what
    the row adds to its site."""
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("counted").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    all_ = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(float(all_["s"] / all_["n"]) if all_["n"] else 0.5, 1e-6), 1 - 1e-6)
    sites = stored(paths.join(hosts, "host"))
    k_host = strength(hosts, "host_n", "host_s", F.lit(mean), mean)
    k_path = strength(sites, "n", "s", F.col("host_s") / F.col("host_n"), mean)
    # one row for each path; Spark splits a path that holds many rows in this join
    own = lambda c: F.col(c) - F.col("counted")
    host_mean = (own("host_s") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    site = (own("s") + k_path * host_mean) / (F.col("n") - 1 + k_path)
    quality = 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(F.col("site")) - logit(F.lit(mean)))))
    return rows.join(sites, ["host", "path"]).withColumn("site", site).withColumn("quality", quality).withColumn("kept", F.col("quality") >= threshold).select("doc_id", "host", "path", "evidence", "site", "quality", "kept")


def hierarchical(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, host, path, evidence, site, quality, kept.

    evidence: the classifier's probability; site: the path's posterior mean without this row; quality: both together;
    kept: quality of ``threshold`` at least. Null texts are empty, very long ones are read whole; null hosts and paths
    are sites of their own. Rows of one doc_id, and equal rows, each count. Labels that are null, repeated (the highest
    counts) or without a document do no harm; without labels of both kinds the evidence is the same for all. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    known = stored(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("label")))
    rows = stored(evidence(docs, classifier(docs, known), host, path))
    rows = rows.join(known, "doc_id", "left").withColumn("counted", F.when(F.col("label").isNull(), F.col("evidence")).when(F.col("label") > 0, 1.0).otherwise(0.0)).drop("label")
    plain = lambda c: F.when(F.col(c) != "null", F.substring(c, 2, 1 << 30)).alias(c)
    return shrunk(stored(rows), threshold).select("doc_id", plain("host"), plain("path"), "evidence", "site", "quality", "kept")
