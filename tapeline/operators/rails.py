"""Trend rails of a price series, and rolling order statistics, in one pass over each series.

A window function would sort all earlier bars anew at every bar; here a series is a group, trailing sums give the fits
and two heaps the quantile so far. A series must fit a task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Bars of each panel's window.
PANELS = {7: 504, 8: 252, 9: 126, 10: 63, 11: 21}
LEAST, QUANTILE, YEAR = 63, 0.95, 252.0


def trend(close: np.ndarray, bars: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(path, yearly growth) at each bar of the log-linear fit to the last ``bars`` bars. Before the first fit, the path
    is the last price and growth the series' own since its first one, from the second price on."""
    n, ok = len(close), np.isfinite(close) & (close > 0)
    y, x = np.log(np.where(ok, close, 1.0)), np.arange(n, dtype=float)
    path, growth = np.full(n, np.nan), np.full(n, np.nan)
    if not n:
        return path, growth
    start = np.maximum(0, np.arange(n) + 1 - bars)
    within = lambda v: (c := np.concatenate([[0.0], np.cumsum(np.where(ok, v, 0.0))]))[1:] - c[start]
    m, sx, sy = within(np.ones(n)), within(x), within(y)
    last = np.maximum.accumulate(np.where(ok, x, -1))
    with np.errstate(all="ignore"):
        ax, ay = sx / m, sy / m
        b = (within(x * y) - sx * ay) / (within(x * x) - sx * ax)
        fit = m >= max(2, min(least, bars))
        path[fit], growth[fit] = np.exp(ay + b * (last - ax))[fit], np.expm1(b * YEAR)[fit]
        first = int(np.argmax(fit)) if fit.any() else n
        seen = np.cumsum(ok)
        if seen[-1] >= 2:
            at = int(np.argmax(ok))
            early = (np.arange(n) < first) & (seen >= 2)
            price = close[np.maximum(last, 0).astype(int)]
            path[early] = price[early]
            growth[early] = ((price / close[at]) ** (YEAR / (last - at)) - 1)[early]
    return path, growth


def quantile_so_far(x: np.ndarray, q: float = QUANTILE, least: int = LEAST) -> np.ndarray:
    """The interpolated quantile of all finite values up to each place, from ``least`` of them on."""
    low: list[float] = []
    high: list[float] = []
    out, n = np.full(len(x), np.nan), 0
    for i, v in enumerate(x.tolist()):
        if v == v and abs(v) != np.inf:
            n += 1
            if low and v <= -low[0]:
                heapq.heappush(low, -v)
            else:
                heapq.heappush(high, v)
            place = q * (n - 1)
            while len(low) <= int(place):
                heapq.heappush(low, -heapq.heappop(high))
            while len(low) > int(place) + 1:
                heapq.heappush(high, -heapq.heappop(low))
        if n >= least:
            rest = q * (n - 1) - int(q * (n - 1))
            out[i] = -low[0] + (rest * (high[0] + low[0]) if rest and high else 0.0)
    return out


def share_up_to(x: np.ndarray, window: int, step: int = 4096) -> np.ndarray:
    """Share of the finite values among the last ``window`` places that are at most the place's own."""
    padded = np.concatenate([np.full(window - 1, np.nan), x])
    seen = np.lib.stride_tricks.sliding_window_view(padded, window) if len(x) else padded.reshape(0, window)
    out = np.full(len(x), np.nan)
    for i in range(0, len(x), step):
        part, own = seen[i : i + step], x[i : i + step]
        n = np.isfinite(part).sum(1)
        with np.errstate(all="ignore"):
            out[i : i + step] = np.where(np.isfinite(own), (part <= own[:, None]).sum(1) / n, np.nan)
    return out


RAIL_COLUMNS = [f"fig{p}_{c}" for p in PANELS for c in ("path", "g", "upper", "lower", "gap")]


def rails(bars: DataFrame) -> DataFrame:
    """``bars`` (code, date, open, high, low, close) with rn, and for each panel path, g, upper, lower and gap."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date", kind="stable").reset_index(drop=True)
        close = g.close.to_numpy(float)
        out = {"rn": np.arange(1, len(g) + 1)}
        for p, n in PANELS.items():
            path, growth = trend(close, n)
            with np.errstate(all="ignore"):
                far = np.exp(quantile_so_far(np.abs(np.log(close / path))))
                far[~np.isfinite(path)] = np.nan
                out |= {f"fig{p}_path": path, f"fig{p}_g": growth, f"fig{p}_upper": path * far, f"fig{p}_lower": path / far, f"fig{p}_gap": close / path - 1}
        return g[["code", "date", "open", "high", "low", "close"]].assign(**out)

    schema = "code string, date date, open double, high double, low double, close double, rn long, " + ", ".join(f"{c} double" for c in RAIL_COLUMNS)
    return _nulls(bars.select("code", "date", "open", "high", "low", "close").groupBy("code").applyInPandas(run, schema))


def with_share(rows: DataFrame, column: str, window: int, name: str) -> DataFrame:
    """``rows`` (code, date, ...) with ``share_up_to`` of a column."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date", kind="stable")
        return g.assign(**{name: share_up_to(g[column].to_numpy(float), window)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {name} double"
    return _nulls(rows.groupBy("code").applyInPandas(run, schema))


def _nulls(df: DataFrame) -> DataFrame:
    """NaN of pandas becomes null."""
    from pyspark.sql import functions as F

    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
