"""Pairwise statistics of a panel by blocks of codes.

A join of the panel with itself has a row for each pair and day. Here codes are dealt to blocks, every pair of blocks is
a group that holds the days of two blocks, and products of its matrices give all of its pairs at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of a block, on average.
BLOCK = 256
LEAST_DAYS, FALLBACK = 120, 0.05
SCHEMA = "code_a string, code_b string, overlap long, corr double"


def complete(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days that both have, correlation over them or NaN) of each column of ``a`` with each of ``b``; NaN is no value."""
    here_a, here_b = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
    x, y = np.nan_to_num(a - _mean(a), posinf=0, neginf=0), np.nan_to_num(b - _mean(b), posinf=0, neginf=0)
    n = here_a.T @ here_b
    with np.errstate(all="ignore"):
        sx, sy = x.T @ here_b / n, here_a.T @ y / n
        vx, vy = (x * x).T @ here_b / n - sx * sx, here_a.T @ (y * y) / n - sy * sy
        corr = (x.T @ y / n - sx * sy) / np.sqrt(vx * vy)
    # what is left of a constant column is rounding
    flat = (vx <= 1e-15 * np.maximum(1e-300, (x * x).max(0, initial=0))[:, None]) | (vy <= 1e-15 * np.maximum(1e-300, (y * y).max(0, initial=0))[None, :])
    return n.astype(np.int64), np.where(flat | ~np.isfinite(corr), np.nan, corr)


def _mean(x: np.ndarray) -> np.ndarray:
    ok = np.isfinite(x)
    return np.where(ok, x, 0).sum(0) / np.maximum(1, ok.sum(0))


def pair_table(panel: DataFrame, least: int = LEAST_DAYS, fallback: float = FALLBACK) -> DataFrame:
    """(code_a, code_b, overlap, corr) for code_a < code_b from (code, date, ret): correlation over common days, within
    -1 and 1; ``fallback`` under ``least`` days or where it isn't defined. A null return is no day. Repeated days of a
    code count once, by their smallest return."""
    panel = panel.where("ret IS NOT NULL").groupBy("code", "date").agg(F.min("ret").alias("ret"))
    n = max(1, -(-panel.select("code").distinct().count() // BLOCK))
    own = F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    dealt = panel.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.select("code", "date", "ret", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="date", columns="code", values="ret").sort_index()
        block = g.drop_duplicates("code").set_index("code").own
        one, two = int(g.a.iloc[0]), int(g.b.iloc[0])
        left, right = ([c for c in wide.columns if block[c] == k] for k in (one, two))
        days, corr = complete(wide[left].to_numpy(float), wide[right].to_numpy(float))
        i, j = np.triu_indices(len(left), 1) if one == two else (x.ravel() for x in np.indices(days.shape))
        names_a, names_b = np.array(left, object)[i], np.array(right, object)[j]
        swap = names_a > names_b
        r = np.where((days[i, j] < least) | np.isnan(corr[i, j]), fallback, np.clip(corr[i, j], -1, 1))
        return pd.DataFrame({"code_a": np.where(swap, names_b, names_a), "code_b": np.where(swap, names_a, names_b), "overlap": days[i, j], "corr": r})

    return dealt.groupBy("a", "b").applyInPandas(run, SCHEMA)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(code, peer, overlap, corr): each pair from either side."""
    back = pairs.select(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "overlap", "corr")
    return pairs.unionByName(back).withColumnsRenamed({"code_a": "code", "code_b": "peer"})


def subset(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs of codes that both are in ``codes`` (code)."""
    for end in ("code_a", "code_b"):
        pairs = pairs.join(codes.select(F.col("code").alias(end)).distinct(), end, "left_semi")
    return pairs.select("code_a", "code_b", "overlap", "corr")
