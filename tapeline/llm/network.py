"""The network of the pseudo-likelihood and the spelling of words that it doesn't know, in numpy."""

from __future__ import annotations

import numpy as np

PLACES = (-2, -1, 1, 2)
HIDDEN = 16
#: Words of a class of the softmax.
WIDE = 128
BATCH = 8192
RATE = 0.2
#: What a weight's sum of squares starts from, so that the first steps of a replica are short.
START = 1e-6
SEED = 7


class Network:
    """Each of the tokens at ``PLACES`` adds a row of its place's table to a hidden layer; its tanh gives a softmax over
    classes and, within a class, over words. ``words`` tokens are known words, by descending frequency, ``WIDE`` of them
    to a class; the token after them is any other word, a class of its own; the last is beyond the text and is never
    predicted."""

    def __init__(self, words: int, weights: np.ndarray | None = None):
        self.words, self.classes = words, -(-words // WIDE)
        self.shapes = [(len(PLACES) * (words + 2), HIDDEN), (HIDDEN,), (self.classes + 1, HIDDEN), (self.classes + 1,), (self.classes, WIDE, HIDDEN), (self.classes, WIDE)]
        sizes = [int(np.prod(s)) for s in self.shapes]
        if weights is None:
            rng = np.random.default_rng(SEED)
            weights = rng.normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat = weights.astype(np.float32)
        self.e, self.b, self.u, self.c, self.uw, self.cw = (p.reshape(s) for p, s in zip(np.split(self.flat, np.cumsum(sizes)[:-1]), self.shapes, strict=True))
        if weights is None or words % WIDE:
            self.cw.reshape(-1)[words:] = -1e9  # places of the last class without a word
        self.square = np.full(len(self.flat), START, np.float32)
        self.se, self.sb, self.su, self.sc, self.suw, self.scw = (p.reshape(s) for p, s in zip(np.split(self.square, np.cumsum(sizes)[:-1]), self.shapes, strict=True))

    def start_from(self, counts: np.ndarray, rest: int) -> None:
        """Biases by the counts of the known words, and of all others together: the network starts as their frequencies."""
        full = np.zeros(self.classes * WIDE)
        full[: self.words] = np.maximum(counts, 0.5)
        by_class = np.append(full.reshape(-1, WIDE).sum(1), max(rest, 0.5))
        self.c[:] = np.log(by_class / by_class.sum())
        self.cw.reshape(-1)[: self.words] = np.log(full[: self.words])
        self.cw -= np.log(full.reshape(-1, WIDE).sum(1))[:, None]
        self.cw.reshape(-1)[self.words :] = -1e9

    def hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = around + np.arange(len(PLACES), dtype=np.int32) * np.int32(self.words + 2)
        h = self.b + self.e.take(rows[:, 0], axis=0)
        for k in range(1, len(PLACES)):
            h += self.e.take(rows[:, k], axis=0)
        return np.tanh(h, out=h), rows

    def by_class(self, token: np.ndarray):
        """(order of the tokens by class, their classes in this order, (class, its start, its end) for each class of known
        words there is)."""
        cls = np.minimum(token // WIDE, self.classes).astype(np.int16 if self.classes < 1 << 15 else np.int32)
        cls[token >= self.words] = self.classes
        order = np.argsort(cls, kind="stable")
        cls = cls[order]
        ends = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        return order, cls, [(c, ends[c], ends[c + 1]) for c in range(self.classes) if ends[c] < ends[c + 1]]

    def log_p(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        order, cls, groups = self.by_class(token)
        token = token[order]
        h, _ = self.hidden(around[order])
        lp = _picked(h @ self.u.T + self.c, cls)
        for c, i, j in groups:
            lp[i:j] += _picked(h[i:j] @ self.uw[c].T + self.cw[c], token[i:j] - c * WIDE)
        out = np.empty_like(lp)
        out[order] = lp
        return out

    def step(self, around: np.ndarray, token: np.ndarray) -> None:
        """One step of Adagrad on a batch; only rows of tokens and classes that occur move."""
        n = np.float32(len(token))
        order, cls, groups = self.by_class(token)
        token = token[order]
        h, rows = self.hidden(around[order])
        p = _slope(h @ self.u.T + self.c, cls, n)
        dh = p @ self.u
        self.moved(self.u, self.su, p.T @ h)
        self.moved(self.c, self.sc, _sums(p.T))
        for c, i, j in groups:
            ha = h[i:j]
            p = _slope(ha @ self.uw[c].T + self.cw[c], token[i:j] - c * WIDE, n)
            dh[i:j] += p @ self.uw[c]
            self.moved(self.uw[c], self.suw[c], p.T @ ha)
            self.moved(self.cw[c], self.scw[c], _sums(p.T))
        dh *= 1 - h * h
        self.moved(self.b, self.sb, _sums(dh.T))
        flat = rows.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(self.e) <= 1 << 16 else flat, kind="stable")
        at = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grad, of = np.add.reduceat(dh.take(order // len(PLACES), axis=0), at, axis=0), flat[order[at]]
        self.se[of] = square = self.se[of] + grad * grad
        self.e[of] -= RATE * grad / np.sqrt(square)

    @staticmethod
    def moved(w: np.ndarray, square: np.ndarray, grad: np.ndarray) -> None:
        square += grad * grad
        w -= RATE * grad / np.sqrt(square)


#: Logits beyond this count as this, so that their powers stay finite.
MOST = np.float32(60)


def _sums(x: np.ndarray) -> np.ndarray:
    """Of each row, as a product, which is faster for short rows."""
    return x @ np.ones(x.shape[1], x.dtype)


def _picked(z: np.ndarray, of: np.ndarray) -> np.ndarray:
    np.minimum(z, MOST, out=z)
    mine = z[np.arange(len(of)), of]
    return mine - np.log(_sums(np.exp(z, out=z)))


def _slope(z: np.ndarray, of: np.ndarray, n: np.float32) -> np.ndarray:
    np.exp(np.minimum(z, MOST, out=z), out=z)
    z *= (1 / (n * _sums(z)))[:, None]
    z[np.arange(len(of)), of] -= 1 / n
    return z


def around(token: np.ndarray, bounds: np.ndarray, beyond: int) -> np.ndarray:
    """The tokens at ``PLACES`` of each token, within its row; ``beyond`` outside."""
    pad, n = max(abs(p) for p in PLACES), len(token)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    row, edge = row.astype(np.int32), np.full(pad, beyond, np.int32)
    wide = np.concatenate([edge, token.astype(np.int32), edge])
    of = np.concatenate([np.full(pad, -1, np.int32), row, np.full(pad, -1, np.int32)])
    out = np.empty((n, len(PLACES)), np.int32)
    for i, k in enumerate(PLACES):
        out[:, i] = np.where(of[pad + k : pad + k + n] == row, wide[pad + k : pad + k + n], beyond)
    return out


#: Symbols of the spelling: 0 ends a word, then letters without case, digits, apostrophe, hyphen, other ASCII, and
#: the bytes of other characters by groups of eight.
SYMBOLS = 56
_SYMBOL = np.full(256, 39, np.int32)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = np.arange(27, 37)
_SYMBOL[39], _SYMBOL[45] = 37, 38
_SYMBOL[128:] = 40 + (np.arange(128) >> 3)
_SYMBOL[[32, 9, 10, 11, 12, 13]] = 0
#: Counts of the spelling: of a symbol after two others, then of bytes.
SPELLED = SYMBOLS**3 + 256


def spelling_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the symbol at each byte after the two before it in its word, code of the end after each word, bytes in
    lower case); codes of bytes outside words mean nothing."""
    n = len(data)
    s = _SYMBOL[data]
    one, two = np.zeros(n, np.int32), np.zeros(n, np.int32)
    one[1:], two[2:] = s[:-1], s[:-2]
    one[starts] = 0
    two[starts] = 0
    second = starts[ends - starts > 1] + 1
    two[second] = 0
    last = s[ends - 1]
    before = np.where(ends - starts > 1, s[np.maximum(ends - 2, 0)], 0)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    return (two * SYMBOLS + one) * SYMBOLS + s, (before * SYMBOLS + last) * SYMBOLS, low


def spelling_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts over the words given by their starts and ends."""
    out = np.zeros(SPELLED, np.int64)
    if len(starts):
        codes, end, low = spelling_places(data, starts, ends)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] = 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        out[: SYMBOLS**3] = np.bincount(codes[inside], minlength=SYMBOLS**3) + np.bincount(end, minlength=SYMBOLS**3)
        out[SYMBOLS**3 :] = np.bincount(low[inside], minlength=256)
    return out


class Spelling:
    """Probability of a word as a string of bytes: symbols by the two before, and bytes by their symbol."""

    def __init__(self, counts: np.ndarray):
        after = counts[: SYMBOLS**3].reshape(-1, SYMBOLS) + 0.05
        self.after = np.log(after / after.sum(1, keepdims=True)).ravel()
        byte = counts[SYMBOLS**3 :] + 0.5
        byte[65:91] = 0  # lower case stands for both
        byte[[32, 9, 10, 11, 12, 13]] = 0
        by_symbol = np.bincount(_SYMBOL, weights=byte, minlength=SYMBOLS)
        self.byte = np.log(np.maximum(byte, 1e-300) / np.maximum(by_symbol[_SYMBOL], 1e-300))

    def log_p(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        codes, end, low = spelling_places(data, starts, ends)
        sums = np.concatenate([[0.0], np.cumsum(self.after[codes] + self.byte[low])])
        return sums[ends] - sums[starts] + self.after[end]
