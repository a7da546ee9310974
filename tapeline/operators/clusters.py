"""Clustering of a pair table: Ward linkage, and components by correlation.

The pair table is built by Spark; the tree is one group of at most a few thousand codes, the components are rounds of joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import stored
from .graph import components


def ward(dist: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) in order of height; new clusters are numbered from n.

    Chains of nearest neighbours: each cluster is followed to its nearest one until two are each other's, which Ward's
    distance allows to merge at once. A step costs a row of the matrix, the whole n squared."""
    n = len(dist)
    d, sizes, alive = dist.astype(float) ** 2, np.ones(n), np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    chain, found = [], []
    while len(found) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            a = chain[-1]
            b = int(np.where(alive, d[a], np.inf).argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        i, j = min(a, b), max(a, b)
        height = d[i, j]
        others = np.flatnonzero(alive)
        others = others[(others != i) & (others != j)]
        s = sizes[others]
        d[i, others] = d[others, i] = np.maximum(0.0, ((s + sizes[i]) * d[i, others] + (s + sizes[j]) * d[j, others] - s * height) / (s + sizes[i] + sizes[j]))
        alive[j] = False
        sizes[i] += sizes[j]
        found.append((float(np.sqrt(height)), i, j))
    up, size, out = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (height, i, j) in enumerate(sorted(found, key=lambda f: f[0])):
        a, b = sorted((root(i), root(j)))
        up[a] = up[b] = n + k
        size[n + k] = size[a] + size[b]
        out.append((a, b, height, size[n + k]))
    return out


def cophenetic(merges: list[tuple[int, int, float, int]], n: int) -> np.ndarray:
    """The height at which each pair of items is first in one cluster."""
    out, members = np.zeros((n, n)), {i: [i] for i in range(n)}
    for k, (a, b, height, _) in enumerate(merges):
        left, right = members.pop(a), members.pop(b)
        out[np.ix_(left, right)] = height
        out[np.ix_(right, left)] = height
        members[n + k] = left + right
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, height: float) -> list[int]:
    """Cluster of each item, numbered from 1 by smallest member, after the merges up to a height."""
    up = list(range(n + len(merges)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, b, h, _) in enumerate(merges):
        if h <= height:
            up[root(a)] = up[root(b)] = n + k
    seen: dict[int, int] = {}
    return [seen.setdefault(root(i), len(seen) + 1) for i in range(n)]


def matrix(g: pd.DataFrame, value: str = "corr", diagonal: float = 1.0, missing: float = 0.05) -> tuple[list[str], np.ndarray]:
    """(codes in order, matrix) from rows (code_a, code_b, value)."""
    codes = sorted(set(g.code_a) | set(g.code_b))
    at = {c: i for i, c in enumerate(codes)}
    out = np.full((len(codes), len(codes)), missing)
    a, b = g.code_a.map(at).to_numpy(), g.code_b.map(at).to_numpy()
    out[a, b] = out[b, a] = g[value].to_numpy()
    np.fill_diagonal(out, diagonal)
    return codes, out


def split_by_corr(clusters: DataFrame, pairs: DataFrame, least: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``clusters`` (by..., code, cluster) with split: each cluster falls apart into components of pairs (by..., code_a,
    code_b, corr) with a correlation of ``least`` or more. The one with the first code keeps the number, the others get new
    ones, by cluster and first code."""
    here = F.struct(*by, "cluster", "code")
    rows = stored(clusters.withColumn("id", here))
    ends = [rows.select(*by, F.col("code").alias(f"code_{x}"), F.col("cluster").alias(f"cluster_{x}"), F.col("id").alias(x)) for x in "ab"]
    near = pairs.where(F.col("corr") >= least).join(ends[0], [*by, "code_a"]).join(ends[1], [*by, "code_b"]).where("cluster_a = cluster_b")
    parts = stored(rows.join(components(rows.select("id"), near.select("a", "b")), "id"))
    # a row a part
    firsts = parts.groupBy(*by, "cluster", "component").agg(F.lit(1).alias("one")).withColumn("first", F.row_number().over(Window.partitionBy(*by, "cluster").orderBy("component")) == 1)
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by, "first").orderBy("cluster", "component")
    firsts = firsts.withColumn("split", F.when(F.col("first"), F.col("cluster")).otherwise(F.max("cluster").over(whole) + F.row_number().over(order)))
    return parts.join(firsts.select("component", "split"), "component").select(*by, "code", "cluster", F.col("split").cast("int").alias("split"))


def ward_clusters(pairs: DataFrame, height: float = 0.40, least_corr: float = 0.55, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., code, cluster, split) from pairs (by..., code_a, code_b, corr); each panel named by ``by`` is a group of the
    tree, and its clusters are split in rounds over the pairs."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        codes, corr = matrix(g)
        return pd.DataFrame({**{c: g[c].iloc[0] for c in by}, "code": codes, "cluster": cut(ward(np.round(1 - corr, 12)), len(codes), height)})

    keys = "".join(f"{c} {dict(pairs.dtypes)[c]}, " for c in by)
    return split_by_corr(pairs.groupBy(*by).applyInPandas(run, keys + "code string, cluster int"), pairs, least_corr, by)


def cophenetic_pairs(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., code_a, code_b, distance) of the Ward tree over 1 - corr, within 0 and 2; what isn't known is 1 apart."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        codes, corr = matrix(g.assign(corr=g["corr"].fillna(0.0)), missing=0.0)
        far = cophenetic(ward(np.clip(np.round(1 - corr, 12), 0, 2)), len(codes))
        i, j = np.triu_indices(len(codes), 1)
        return pd.DataFrame({**{c: g[c].iloc[0] for c in by}, "code_a": np.array(codes, object)[i], "code_b": np.array(codes, object)[j], "distance": far[i, j]})

    keys = "".join(f"{c} {dict(pairs.dtypes)[c]}, " for c in by)
    return pairs.groupBy(*by).applyInPandas(run, keys + "code_a string, code_b string, distance double")
