"""Words of many texts at once, as 64-bit hashes, from Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are hashed at once: a task takes about 100 bytes of memory for each.
CHUNK = 1 << 19
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        table = np.full(max(n, CHUNK), base, np.uint64)
        table[0] = 1
        out = np.cumprod(table)
        if n > 4 << 20:  # a very long text's own, not kept
            return out
        _powers[name] = out
    return _powers[name]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows): runs of rows with about ``most`` bytes, one at least.
    Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each row and after the last): words of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    return word_spans(data, offs)[:2]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, with the start and the end of each word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sep = _SEP[data]
    first, last = ~sep, ~sep
    inner = offs[(offs > 0) & (offs < n)]
    first[1:] &= sep[:-1]
    first[inner] = ~sep[inner]
    last[:-1] &= sep[1:]
    last[inner - 1] = ~sep[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * _table("up", _BASE, n)[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _table("down", _INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offs), starts, ends


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``size``-word shingles; with fewer words, of all words as one."""
    step = np.uint64(_BASE | 1)
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * step + words[k : k + n]
    h = mixed(h)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            yield np.unique(h[a : b - size + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = one * step + words[k]
            yield mixed(one)
        else:
            yield np.zeros(0, np.uint64)
