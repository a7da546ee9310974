"""Path-dependent operators: one pass over the bars of a series, inside an Arrow grouped map.

Everything that a window can express is computed before; only the state machines run here. A series is one key, whose
bars must fit a task (daily bars: a few thousand rows a code).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_code(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy("code").applyInPandas(lambda g: run(g.sort_values("date", kind="stable").reset_index(drop=True)), schema)


class Counter:
    """Consecutive bars for which a condition holds."""

    def __init__(self):
        self.n = 0

    def see(self, holds: bool) -> int:
        self.n = self.n + 1 if holds else 0
        return self.n


def hysteresis(raw, close, ma20, ma60, confirm: int = 2) -> list[str]:
    """States up / down / range that follow raw labels with delay: soft exits by drawdown or bounce, a guard of three
    bars after a decline, and no new decline while the close holds above the last trough. A missing average counts
    as not above."""
    state, above, below, out = "range", Counter(), Counter(), []
    peak = trough = None
    guard = 0
    for label, c, a, b in zip(raw, close, ma20, ma60, strict=True):
        over = bool(c > a)
        up, down = above.see(over), below.see(not over)
        if state == "up":
            peak = c if peak is None else max(peak, c)
            if label == "down" and (down >= confirm or a < b):
                state, trough, peak, guard = "down", c, None, 0
            elif down >= 2 or c / peak - 1 <= -0.06 or (label == "range" and down >= confirm + 1):
                state, peak, trough = "range", None, None
        elif state == "down":
            trough = c if trough is None else min(trough, c)
            if label == "up" and (up >= confirm or a > b):
                state, peak, trough, guard = "up", c, None, 0
            elif up >= 2 or c / trough - 1 >= 0.04 or (label == "range" and up >= confirm):
                state, guard, peak = "range", 3, None
        else:
            guard = max(0, guard - 1)
            if label == "up" and (up >= confirm or a > b):
                state, peak, trough, guard = "up", c, None, 0
            elif label == "down" and (down >= confirm or a < b):
                held = trough is not None and c > trough
                if not held and not (guard > 0 and down < max(confirm, 3)):
                    state, trough, guard = "down", c, 0
        out.append(state)
    return out


def stack_hysteresis(raw, close, ma20, ma60, enter: int = 3, leave: int = 3) -> list[str]:
    """As above on the order of the two averages, with confirmed entries and a drawdown of 12 %."""
    state, out = "range", []
    bull, bear, above, below = Counter(), Counter(), Counter(), Counter()
    peak = trough = None
    for label, c, a, b in zip(raw, close, ma20, ma60, strict=True):
        n_bull, n_bear, n_up, n_down = bull.see(a > b), bear.see(a < b), above.see(c > a), below.see(not c > a)
        if state == "up":
            peak = c if peak is None else max(peak, c)
            if n_bear >= leave:
                state, trough, peak = "down", c, None
            elif n_down >= 3 or c / peak - 1 <= -0.12 or (label == "range" and n_bear >= enter):
                state, peak, trough = "range", None, None
        elif state == "down":
            trough = c if trough is None else min(trough, c)
            if n_bull >= leave and n_up >= enter:
                state, peak, trough = "up", c, None
            elif n_up >= 3 or c / trough - 1 >= 0.04 or (label == "range" and n_bull >= enter):
                state, peak, trough = "range", None, None
        elif label == "up" and n_bull >= enter and n_up >= enter:
            state, peak, trough = "up", c, None
        elif label == "down" and n_bear >= enter and n_down >= enter:
            state, peak, trough = "down", None, c
        out.append(state)
    return out


def sticky_up(labels, close, ma20, days: int = 3, drawdown: float = 0.18, wait: int = 2) -> list[str]:
    """Ends a run of up after so many bars below the average, or below it at such a drawdown, as range; up counts again
    only after so many bars at or above the average."""
    out, below, guard, peak = [], Counter(), 0, None
    for label, c, m in zip(labels, close, ma20, strict=True):
        if label != "up" or guard > 0:
            guard = guard - bool(c >= m) if label == "up" else 0
            below.see(False)
            peak = None
            out.append("range" if label == "up" else label)
            continue
        peak = c if peak is None else max(peak, c)
        n = below.see(bool(c < m))
        leaves = n >= days or (n >= 1 and c / peak - 1 <= -drawdown)
        if leaves:
            below.see(False)
            guard, peak = wait, None
        out.append("range" if leaves else "up")
    return out


def runs(labels: list[str]) -> list[tuple[int, int]]:
    """(first, last + 1) of each maximal run."""
    cuts = [0, *(i for i in range(1, len(labels)) if labels[i] != labels[i - 1]), len(labels)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if labels else []


def merge_short(labels: list[str], least: int, passes: int = 2) -> list[str]:
    """Short runs that aren't range take the label to their left as rewritten so far; a short first run takes the right
    neighbour's, a single short run becomes range."""
    for _ in range(passes):
        out, found = list(labels), runs(labels)
        for a, b in found:
            if b - a < least and labels[a] != "range":
                fill = out[a - 1] if a else labels[b] if b < len(labels) else "range"
                out[a:b] = [fill] * (b - a)
        if out == labels:
            break
        labels = out
    return labels


def rule_machine(close, buy, sell, g1=None, trail: float = 0.0, cost: float = 0.0005) -> dict:
    """Signals at a bar, fills at the next. A latch set by ``g1`` while holding masks sells; a trailing stop counts from
    the bar after the fill. Returns equity, trades (signal bar, fill bar, exit bar, return, reason) and the last state:
    action, holding, latch, peak, why the last bar sells, and whether the latch masks a sell there."""
    n = len(close)
    held, trades = np.zeros(n + 1), []
    fill = peak = why = None
    latch, masked, action = False, False, "none"
    for i in range(n):
        why, masked = None, False
        if fill is None:
            action = "none"
            if buy[i]:
                fill, peak, latch, action = i + 1, None, False, "buy"
                held[i + 1 :] = 1
            continue
        action = "hold"
        latch = latch or bool(g1 is not None and g1[i])
        if i < fill:
            continue
        peak = close[i] if peak is None else max(peak, close[i])
        masked = bool(sell[i] and latch)
        why = "sell" if sell[i] and not latch else "trail" if trail and i > fill and close[i] <= peak * (1 - trail) else None
        if why:
            action = "sell"
            held[i + 1 :] = 0
            if i + 1 < n:
                trades.append((fill - 1, fill, i + 1, close[i + 1] / close[fill] - 1, why))
            fill = None
    weight = np.concatenate([[0.0], held[: n - 1]]) if n else np.zeros(0)
    r = np.concatenate([[0.0], np.diff(close) / np.asarray(close[:-1], float)]) if n else np.zeros(0)
    turn = np.abs(np.diff(np.concatenate([[0.0], held[:n]])))
    return {"equity": np.cumprod(1 + weight * r - turn * cost), "trades": trades, "action": action, "holding": bool(n and held[n - 1]), "latch": latch, "peak": peak, "why": why, "masked": masked}
