"""Segmentation methods as whole series of labels, look-ahead swings, and the choice of a method for each series.

``Series`` holds what SQL has computed: columns of one code in order of date, numbers without nulls where a rule takes
them as 0. Raw labels come from SQL too, but for the two rules with thresholds of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from . import scans

#: Methods in the order in which they are tried, and the thresholds that are tried.
METHODS = ("ma_stack_hyst", "ma_stack_struct", "ma_stack_strict", "dual_ma_cross", "adx_di", "prior60_band", "hybrid_ma_adx")
P60, VREV, CONFIRM, SMOOTH, MIN_SEG, ADX = (0.03, 0.06, 0.10), (0.03, 0.06), (1, 3), (3, 5), (5, 10), (18.0, 22.0)
FALLBACK, FIXED = "ma_stack_hyst", "hybrid_ma_adx"
MIN_TRAIN, MIN_EVAL, COST = 120, 5, 0.001
COLUMNS = "code, date, close, pc, ma20, ma60, p20, p60, adx, plus, minus, g1_raw, g2_raw, g4_raw, g5_raw, g6_raw, quiet"


def grid(method: str) -> list[dict]:
    """Parameters to try, those of the method itself first."""
    axes = {
        "ma_stack_strict": {"p60_thr": P60, "p20_vrev": VREV, "confirm": CONFIRM, "min_seg": MIN_SEG},
        "adx_di": {"adx_thr": ADX, "smooth": SMOOTH, "min_seg": MIN_SEG},
        "prior60_band": {"min_seg": MIN_SEG},
    }.get(method, {"confirm": CONFIRM, "smooth": SMOOTH, "min_seg": MIN_SEG})
    combos = pd.MultiIndex.from_product(axes.values())
    return [{}, *(dict(zip(axes, c if isinstance(c, tuple) else (c,), strict=True)) for c in combos)]


def mode(labels: list[str], window: int) -> np.ndarray:
    """Most frequent label of the last bars, ties to the first in the alphabet."""
    names = np.array(["down", "range", "up"])
    seen = np.cumsum(np.asarray(labels)[:, None] == names, axis=0) if len(labels) else np.zeros((0, 3), int)
    seen[window:] -= seen[:-window].copy()
    return names[seen.argmax(1)] if len(labels) else np.array([], dtype=str)


def strict_raw(s: pd.DataFrame, p60_thr: float, p20_vrev: float) -> np.ndarray:
    known = s.ma20.notna() & s.ma60.notna()
    over, stacked = s.close > s.ma20, s.ma20 > s.ma60
    washed = (s.p60 <= -0.08) & (s.ma60 > 0) & (s.ma20 / s.ma60 - 1 > -0.05) & (s.pc.isna() | (s.close >= s.pc))
    trend = stacked & over & (s.p60 >= p60_thr) & (s.p20 >= 0)
    turn = over & (s.p20 >= p20_vrev) & (stacked | washed | (s.p60 >= 0.08))
    strong = stacked & over & (s.p60 >= max(0.18, 3 * p60_thr)) & (s.p20 >= -0.08)
    down = (s.ma20 < s.ma60) & (s.close < s.ma20) & (s.p60 <= -p60_thr) & (s.p20 <= 0)
    return np.select([~known, trend | turn | strong, down], ["range", "up", "down"], "range")


def directional_raw(s: pd.DataFrame, adx_thr: float) -> np.ndarray:
    return np.select([s.adx < adx_thr, s.plus > s.minus, s.minus > s.plus], ["range", "up", "down"], "range")


def labels(s: pd.DataFrame, method: str, params: dict | None = None) -> np.ndarray:
    """Final labels: raw rule, hysteresis, smoothing, range in lasting low volatility, short runs merged."""
    p = params or {}
    confirm, smooth = p.get("confirm", 3), p.get("smooth", 3)
    calm = lambda raw, n: scans.hysteresis(raw, s.close, s.ma20, s.ma60, n)
    stack = lambda raw: scans.stack_hysteresis(raw, s.close, s.ma20, s.ma60, confirm, confirm)
    if method == "prior60_band":
        out = mode(list(s.g6_raw), 5)
    elif method == "ma_stack_struct":
        out = mode(stack(s.g2_raw), smooth)
    elif method == "dual_ma_cross":
        out = mode(stack(s.g4_raw), smooth)
    elif method == "ma_stack_strict":
        out = mode(calm(strict_raw(s, p.get("p60_thr", 0.06), p.get("p20_vrev", 0.06)), confirm), smooth)
    elif method == "adx_di":
        out = mode(calm(directional_raw(s, p["adx_thr"]) if "adx_thr" in p else s.g5_raw, 2), smooth)
    elif method in ("ma_stack_hyst", "hybrid_ma_adx"):
        out = mode(calm(s.g1_raw, confirm), smooth)
        if method == "hybrid_ma_adx":
            moving = (s.p60.abs() >= 0.06) | (s.p20.abs() >= 0.04)
            rising = (out == "up") & (s.close > s.ma20) & (s.p20 >= 0.02)
            out = np.where((s.adx < 15) & ~moving & ~rising, "range", out)
    else:
        raise ValueError(f"no method {method!r}")
    return np.array(scans.merge_short(list(np.where(s.quiet, "range", out)), p.get("min_seg", 10)), dtype=object)


def swings(level: np.ndarray, prominence: float, distance: int) -> Iterator[tuple[int, str]]:
    """Alternating highs and lows (place, H or L), each the most extreme one until a far enough turn."""
    at, kind = 0, None
    for i in range(1, len(level) - 1):
        top = level[i] >= max(level[i - 1], level[i + 1])
        if not top and level[i] > min(level[i - 1], level[i + 1]):
            continue
        here = "H" if top else "L"
        if kind is None or (here == kind and (level[i] >= level[at] if top else level[i] <= level[at])):
            at, kind = i, here
        elif here != kind and i - at >= distance and abs(level[i] - level[at]) / max(level[at], 1e-8) >= prominence:
            yield at, kind
            at, kind = i, here
    yield at, kind or "L"


def truth(close, prominence: float = 0.18, distance: int = 25, swing: float = 0.22, least: int = 30) -> np.ndarray:
    """Look-ahead labels from major swings, for training only; under 60 bars all are range."""
    close = np.asarray(close, float)
    n, out = len(close), np.full(len(close), "range", dtype=object)
    if n < 60:
        return out
    other = {"H": "L", "L": "H"}
    ends = list(swings(pd.Series(close).rolling(8, min_periods=1).mean().to_numpy(), prominence, distance))
    if ends[0][0] > 0:
        ends = [(0, other[ends[0][1]]), *ends]
    if ends[-1][0] < n - 1:
        ends.append((n - 1, other[ends[-1][1]]))
    legs: list[list] = []

    def add(first: int, last: int, label: str, absorb: bool) -> None:
        if legs and (legs[-1][2] == label or absorb):
            legs[-1][1] = last
        else:
            legs.append([first, last, label])

    for (a, x), (b, y) in zip(ends[:-1], ends[1:], strict=True):
        move = close[b] / close[a] - 1
        add(a, b, "up" if x + y == "LH" and move >= swing else "down" if x + y == "HL" and move <= -swing else "range", False)
    merged, legs[:] = list(legs), []
    for a, b, label in merged:
        add(a, b, label, b - a + 1 < least)
    for a, b, label in legs:  # a later leg takes the bar that two share
        out[a : b + 1] = label
    return out


def trades(label: np.ndarray, close: np.ndarray) -> list[tuple[float, bool]]:
    """(exit / entry, still open) of holding while up: bought at a run's first bar, sold at the first bar after it."""
    last = len(close) - 1
    return [(close[min(b, last)] / close[a], b > last) for a, b in scans.runs(list(label)) if label[a] == "up"]


def truth_between(close, days, first, last):
    """The look-ahead labels of all bars, of those from ``first`` to ``last`` only."""
    days = np.asarray(days)
    return np.asarray(truth(close), object)[(days >= first) & (days <= last)]


def score(label: np.ndarray, close: np.ndarray, true: np.ndarray) -> float:
    gain = float(np.prod([r for r, _ in trades(label, close)])) - 1
    return 0.45 * gain + 0.25 * float((label == true).mean()) + 0.15 * float((label == "up").mean()) - 0.015 * (len(scans.runs(list(label))) - 1)


def choose(s: pd.DataFrame) -> tuple[str, dict, float, bool]:
    """(method, parameters, score, whether the truth was too flat to choose by). Labels that collapse into range or
    starve the directions of the truth don't count; of equal scores the first stays."""
    close = s.close.to_numpy(float)
    true = truth(close)
    flat = float((true == "range").mean())
    if flat >= 0.90 or 1 - flat < 0.05:
        return FALLBACK, {}, score(labels(s, FALLBACK), close, true), True
    best, plain = None, {}
    for method in METHODS:
        for params in grid(method):
            got = labels(s, method, params)
            ranged, value = float((got == "range").mean()), score(got, close, true)
            plain.setdefault(method, value)
            collapsed = ranged >= 0.85 or (ranged >= 0.75 and ranged > flat + 0.35 and flat >= 0.30)
            starved = 1 - flat >= 0.20 and 1 - ranged < 0.25 * (1 - flat) and ranged >= 0.65
            if not collapsed and not starved and (best is None or value > best[2]):
                best = method, params, value, False
    if best:
        return best
    top = max(plain, key=plain.get)
    return top, {}, plain[top], False


def trained(s: pd.DataFrame, cutoff) -> tuple[str, dict, float, bool, int]:
    """``choose`` on the bars before ``cutoff`` and their number; the fixed method where they are under 120."""
    before = s[s.date < cutoff]
    return (*choose(before), len(before)) if len(before) >= MIN_TRAIN else (FIXED, {}, 0.0, False, len(before))


def evaluated(s: pd.DataFrame, method: str, params: dict, start) -> dict:
    """Holding while up from ``start`` on, against holding throughout; all bars, and clipped, where fewer
    than five are left."""
    inside = (s.date >= start).to_numpy()
    clipped = bool(inside.sum() < MIN_EVAL)
    if clipped:
        inside[:] = True
    close = s.close.to_numpy(float)[inside]
    done = trades(labels(s, method, params)[inside], close)
    compound = float(np.prod([r for r, _ in done])) * (1 - COST) ** sum(1 if still else 2 for _, still in done) - 1
    held = close[-1] / close[0] - 1
    return {"bars": len(close), "compound": compound, "bh": held, "edge": compound - held, "n": len(done), "clipped": clipped}
