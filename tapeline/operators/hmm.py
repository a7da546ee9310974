"""A hidden Markov model of returns: Student-t emissions, fitted by expectation-maximisation, filtered forward.

A series of returns must fit a task; the steps run over its bars, and within a step over all states at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

TINY = 1e-12
LEAST = 60
SEPARATED = 1.15


@dataclass
class Model:
    start: np.ndarray
    trans: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    loglik: float = math.nan
    rounds: int = 0
    reliable: bool = False

    @property
    def separation(self) -> float:
        """Least ratio of the deviations of two states."""
        s = np.sort(self.sigma)
        return float((s[1:] / s[:-1]).min()) if len(s) > 1 else 1.0

    def sorted(self) -> Model:
        o = np.argsort(self.sigma, kind="stable")
        return Model(self.start[o], self.trans[np.ix_(o, o)], self.mu[o], self.sigma[o], self.loglik, self.rounds, self.reliable)


def log_density(r: np.ndarray, m: Model, nu: float) -> np.ndarray:
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    z = (r[:, None] - m.mu) / m.sigma
    return const - (nu + 1) / 2 * np.log1p(z * z / nu) - np.log(m.sigma)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def initial(r: np.ndarray, k: int) -> Model:
    """States from quantile buckets of the absolute returns; two states from their median."""
    trans = np.full((k, k), 0.1 / (k - 1))
    np.fill_diagonal(trans, 0.9)
    size = np.abs(r)
    if k == 2:
        mid = float(np.median(size))
        return Model(np.full(2, 0.5), trans, np.zeros(2), np.array([max(0.7 * mid, 1e-4), max(2 * mid, 2e-4)]))
    bucket = np.searchsorted(np.quantile(size, np.arange(1, k) / k), size, side="right")  # a bucket holds its lower edge
    parts = [r[bucket == i] for i in range(k)]
    mu = np.array([p.mean() if len(p) else 0.0 for p in parts])
    sigma = np.array([max(p.std(ddof=1), 1e-4) if len(p) > 1 else 1e-4 for p in parts])
    return Model(np.full(k, 1 / k), trans, mu, sigma)


def posteriors(r: np.ndarray, m: Model, nu: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights of the states at each bar, expected transitions, log-likelihood)."""
    emit, step = log_density(r, m, nu), np.log(np.maximum(m.trans, TINY))
    ahead, back = np.empty_like(emit), np.zeros_like(emit)
    ahead[0] = np.log(np.maximum(m.start, TINY)) + emit[0]
    for t in range(1, len(r)):
        ahead[t] = log_sum(ahead[t - 1][:, None] + step, 0) + emit[t]
    for t in range(len(r) - 2, -1, -1):
        back[t] = log_sum(step + emit[t + 1] + back[t + 1], 1)
    total = float(log_sum(ahead[-1], 0))
    moves = np.exp(ahead[:-1, :, None] + step + (emit[1:] + back[1:])[:, None, :] - total).sum(0)
    return np.exp(ahead + back - total), moves, total


def fit(returns, k: int = 3, nu: float = 5.0, rounds: int = 80, tol: float = 1e-6) -> Model:
    """The states come in order of their deviation. Under 60 returns, or where it diverges, the model isn't reliable."""
    r = np.asarray(returns, float)
    r = r[np.isfinite(r)]
    if len(r) < LEAST:
        return Model(np.full(k, 1 / k), np.full((k, k), 1 / k), np.full(k, math.nan), np.full(k, math.nan))
    least = max(0.15 * float(np.median(np.abs(r))), 1e-4) if k > 2 else 1e-5
    m, before = initial(r, k), -math.inf
    for i in range(rounds):
        weight, moves, total = posteriors(r, m, nu)
        if not math.isfinite(total):
            return m
        trans = np.maximum(moves / np.maximum(moves.sum(1, keepdims=True), TINY), 1e-3)
        mass = np.maximum(weight.sum(0), TINY)
        mu = weight.T @ r / mass
        sigma = np.sqrt((weight * (r[:, None] - mu) ** 2).sum(0) / mass)
        m = Model(weight[0] / weight[0].sum(), trans / trans.sum(1, keepdims=True), mu, np.maximum(sigma, least), total, i + 1).sorted()
        if abs(total - before) < tol:
            break
        before = total
    m.reliable = bool(np.isfinite(m.mu).all() and np.isfinite(m.sigma).all())
    return m


def posteriors_all(r: np.ndarray, n: np.ndarray, start: np.ndarray, trans: np.ndarray, mu: np.ndarray, sigma: np.ndarray, nu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``posteriors`` for many series at once, a step of all of them at a time. r: [series, bar], of which the first ``n``
    of each series count; start, mu, sigma: [series, state]; trans: [series, state, state]. Weights past the end are 0."""
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    z = (r[:, :, None] - mu[:, None]) / sigma[:, None]
    emit, step = const - (nu + 1) / 2 * np.log1p(z * z / nu) - np.log(sigma)[:, None], np.log(np.maximum(trans, TINY))
    ahead, back = np.empty_like(emit), np.zeros_like(emit)
    ahead[:, 0] = np.log(np.maximum(start, TINY)) + emit[:, 0]
    for t in range(1, r.shape[1]):
        ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + step, 1) + emit[:, t]
    for t in range(r.shape[1] - 2, -1, -1):
        back[:, t] = np.where((t + 1 < n)[:, None], log_sum(step + (emit[:, t + 1] + back[:, t + 1])[:, None], 2), 0)
    total = log_sum(ahead[np.arange(len(r)), n - 1], 1)
    inside = np.arange(r.shape[1]) < n[:, None]
    last = inside[:, 1:, None, None]
    moves = np.exp(np.where(last, ahead[:, :-1, :, None] + step[:, None] + (emit[:, 1:] + back[:, 1:])[:, :, None] - total[:, None, None, None], -np.inf)).sum(1)
    return np.exp(np.where(inside[:, :, None], ahead + back - total[:, None, None], -np.inf)), moves, total


def padded(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in series])
    out = np.zeros((len(series), n.max(initial=1)))
    for row, r in zip(out, series, strict=True):
        row[: len(r)] = r
    return out, n


def fit_all(series: list[np.ndarray], k: int = 3, nu: float = 5.0, rounds: int = 80, tol: float = 1e-6) -> list[Model]:
    """``fit`` of many series; each stops by itself."""
    clean = [np.asarray(r, float)[np.isfinite(np.asarray(r, float))] for r in series]
    out = [initial(r, k) if len(r) >= LEAST else fit(r, k) for r in clean]
    live = [i for i, r in enumerate(clean) if len(r) >= LEAST]
    before, least = dict.fromkeys(live, -math.inf), {i: max(0.15 * float(np.median(np.abs(clean[i]))), 1e-4) if k > 2 else 1e-5 for i in live}
    done = set()
    for turn in range(rounds):
        if not live:
            break
        r, n = padded([clean[i] for i in live])
        weight, moves, total = posteriors_all(r, n, *(np.array([getattr(out[i], x) for i in live]) for x in ("start", "trans", "mu", "sigma")), nu)
        trans = np.maximum(moves / np.maximum(moves.sum(2, keepdims=True), TINY), 1e-3)
        trans /= trans.sum(2, keepdims=True)
        mass = np.maximum(weight.sum(1), TINY)
        mu = np.einsum("bts,bt->bs", weight, r) / mass
        sigma = np.sqrt((weight * (r[:, :, None] - mu[:, None]) ** 2).sum(1) / mass)
        left = []
        for b, i in enumerate(live):
            if not math.isfinite(total[b]):
                continue  # diverged: not reliable
            out[i] = Model(weight[b, 0] / weight[b, 0].sum(), trans[b], mu[b], np.maximum(sigma[b], least[i]), float(total[b]), turn + 1).sorted()
            if abs(total[b] - before[i]) < tol:
                done.add(i)
            else:
                before[i] = float(total[b])
                left.append(i)
        live = left
    for i in done | set(live):
        out[i].reliable = bool(np.isfinite(out[i].mu).all() and np.isfinite(out[i].sigma).all())
    return out


def filtered(returns, m: Model, nu: float = 5.0, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of the states at each bar from the returns up to it, starting from ``start`` or equal ones. A missing return
    keeps the weights as they are."""
    r = np.asarray(returns, float)
    now, out = np.full(len(m.mu), 1 / len(m.mu)) if start is None else start, np.empty((len(r), len(m.mu)))
    dense = np.exp(log_density(np.nan_to_num(r), m, nu))
    for t in range(len(r)):
        if math.isfinite(r[t]):
            now = (now @ np.maximum(m.trans, TINY)) * dense[t]
            now = now / max(now.sum(), 1e-300)
        out[t] = now
    return out


#: Names of three states: the calmest one, then the lower and the higher mean.
NAMES = ("calm", "bear_grind", "volatile_reversal")
REVERSAL = 2


def named(m: Model) -> Model:
    """The states in the order of ``NAMES``. Equal means are told apart by deviation, then by place."""
    calm = min(range(len(m.mu)), key=lambda i: (m.sigma[i], abs(m.mu[i]), i))
    rest = [i for i in range(len(m.mu)) if i != calm]
    if len(rest) == 2:
        low, high = rest
        if abs(m.mu[low] - m.mu[high]) > 1e-8:
            rest = sorted(rest, key=lambda i: m.mu[i])
        elif m.sigma[low] - m.sigma[high] > 1e-8:
            rest = [high, low]
    o = np.array([calm, *rest])
    return Model(m.start[o], m.trans[np.ix_(o, o)], m.mu[o], m.sigma[o], m.loglik, m.rounds, m.reliable)


def ahead(weights: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Weights of the states one bar on, for each row of ``weights``; rows without mass stay as they are."""
    w = np.atleast_2d(np.asarray(weights, float))
    mass = w.sum(1, keepdims=True)
    out = np.divide(w, mass, out=w.copy(), where=mass > 0) @ trans
    total = out.sum(1, keepdims=True)
    return np.where((mass > 0) & (total > 0), out / np.where(total > 0, total, 1), w)


def moved(xi: np.ndarray) -> dict[str, float]:
    """Of joint weights (state before, state now) that add up to one: the chance of any change, of a change to the last
    named state, and the weights now."""
    now = xi.sum(0) / max(float(xi.sum()), TINY)
    into = float(xi[:, REVERSAL].sum() - xi[REVERSAL, REVERSAL]) if len(xi) > REVERSAL else 0.0
    return {"switch": float(xi.sum() - np.trace(xi)), "into_reversal": into, **{f"state_{n}": float(p) for n, p in zip(NAMES, now, strict=False)}}


def stays(m: Model, horizons: tuple[int, ...] = (5, 10, 20)) -> dict[int, float | None]:
    """Chance that the last named state is not left within so many bars."""
    return {h: float(m.trans[REVERSAL, REVERSAL] ** h) if len(m.mu) > REVERSAL else None for h in horizons}
