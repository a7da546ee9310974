"""Masked pseudo-likelihood: each token is predicted from the tokens on both of its sides.

The network (``network.Network``) is a bidirectional window whose softmax goes over classes and then over words. It knows
the most frequent words, counted over all documents; any other word is one token, which the network predicts too, and
then has a probability of its own: that of its spelling, by symbols that follow each other in such words, mixed with
what the corpus remembers. The memory holds every window of four neighbours around an unknown word that occurs more than
once in all documents, and the word that stood in it each time; a window that held different words points at none. It is
a distributed table that grows with the corpus, and is joined.

Training is a function of the documents alone, not of how they are dealt to tasks. Documents are cut into pieces, which a
hash deals to rounds and to cells; each cell, in the order of its hashes, trains a replica that starts from the weights
of the round before, and the replicas' weights are averaged in fixed point. Every token of every document is a target
once: a window never holds the token it predicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .network import BATCH, PLACES, SPELLED, Network, Spelling, around, spelling_counts
from .words import chunks, mixed, word_hashes, word_spans

#: Words that the network knows, by descending frequency.
WORDS = 4096
#: Rounds of training, each on its own part of the documents, and tokens of a cell in a round.
ROUNDS, CELL = 4, 1 << 18
#: Tokens of a piece. The ends of a piece see neighbours on one side only in training, never in scoring.
PIECE = 4096
#: Weights are averaged as whole multiples of 2 ** -FIXED, in blocks.
FIXED, WEIGHTS = 24, 1 << 16
SPELLING_BLOCK = 1 << 14
#: Bits of a word's hash that name its slot in the table of known words.
SLOTS = 20
#: Bytes of text that are scored at once.
RUN = 1 << 19
#: Keys that a task holds before it puts them out, windows of a block of the memory, and what is known of a window: how
#: often it comes, and the least and the greatest word in it.
HELD, BLOCK = 1 << 19, 1 << 19
SEEN = np.dtype([("key", "<u8"), ("n", "<i8"), ("low", "<i4"), ("high", "<i4")])
#: Bits of the flags for each window that is remembered, and powers of two between which their number lies.
FLAGS, FEWEST, MOST = 16, 16, 29


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Records of one key each, by key: ``n`` is added up, ``low`` and ``high`` are the least and the greatest."""
    rows = np.concatenate(parts)
    order = np.argsort(rows["key"])
    key = rows["key"][order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    out = np.empty(len(at), rows.dtype)
    out["key"] = key[at]
    for name, add in (("n", np.add), ("low", np.minimum), ("high", np.maximum)):
        if name in rows.dtype.names and len(at):
            out[name] = add.reduceat(rows[name][order], at)
    return out


def combined(parts, most: int):
    """Merged records, put out when more than ``most`` keys are held, and at the end."""
    held, n = [], 0
    for rows in parts:
        held.append(rows)
        n += len(rows)
        if n > 2 * most:
            held = [merged(held)]
            n = len(held[0])
            if n > most:
                yield held[0]
                held, n = [], 0
    if held:
        yield merged(held)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): the hash of each word of all documents and how often it comes."""

    def counted(batches):
        for b in batches:
            for _, _, data, offs in chunks(b.column(0)):
                h, n = np.unique(word_hashes(data, offs)[0], return_counts=True)
                rows = np.empty(len(h), [("key", "<u8"), ("n", "<i8")])
                rows["key"], rows["n"] = h, n
                yield rows

    def count(batches):
        for rows in combined(counted(batches), HELD):
            yield pa.RecordBatch.from_pydict({"h": rows["key"].view(np.int64).copy(), "n": rows["n"].copy()})

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Tokens:
    """From words to tokens: 0 .. size - 1 for the words known, ``size`` for any other, and ``size + 1`` beyond the text."""

    def __init__(self, words: list[int]):
        self.known, self.size = np.append(np.array(words, np.int64).view(np.uint64), np.uint64(0)), len(words)
        # a slot of the hash names the first word that has it; the few others are compared one by one
        slot = (self.known[:-1] >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.table, (_, first) = np.full(1 << SLOTS, self.size, np.int32), np.unique(slot, return_index=True)
        self.table[slot[first]] = first
        self.late = np.setdiff1d(np.arange(self.size), first)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = self.table[hashes >> np.uint64(64 - SLOTS)]
        out = np.where(self.known[at] == hashes, at, self.size).astype(np.int64)
        for k in self.late:
            out[hashes == self.known[k]] = k
        return out


def added(parts: DataFrame, width: int) -> np.ndarray:
    """Element-wise sums of (block, values), blocks of ``width`` longs, by the tasks that get them. What comes to the
    driver has the size of one array, whatever the number of parts."""

    def run(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), "<i8")
                got[k] = got[k] + x if k in got else x
        for k, x in got.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "values": pa.array([x.tobytes()], pa.binary())})

    rows = {k: np.frombuffer(x, "<i8") for k, x in parts.repartition("block").mapInArrow(run, "block int, values binary").collect()}
    return np.concatenate([rows[k] for k in range(max(rows) + 1)]) if rows else np.zeros(0, np.int64)


def blocks(x: np.ndarray, width: int) -> pa.RecordBatch:
    cut = [x[i : i + width].astype("<i8").tobytes() for i in range(0, len(x), width)]
    return pa.RecordBatch.from_pydict({"block": pa.array(range(len(cut)), pa.int32()), "values": pa.array(cut, pa.binary())})


def cells(docs: DataFrame, words: list[int], total: int) -> DataFrame:
    """(cell, round, tokens, bounds): the training tokens of each cell; bounds are where its pieces start and end. Cells
    below 0 are blocks of the spelling's counts over all unknown words."""
    tokens, n_cells = Tokens(words), max(1, -(-total // (ROUNDS * CELL)))

    names = ["cell", "round", "key", "tokens"]

    def cut(batches):
        spelled = np.zeros(SPELLED, np.int64)
        for b in batches:
            for i, j, data, offs in chunks(b.column(1), RUN):
                hashes, bounds, begin, end = word_spans(data, offs)
                token = tokens.of(hashes).astype("<u2")
                if not len(token):
                    continue
                rest = token == tokens.size
                spelled += spelling_counts(data, begin[rest], end[rest])
                of = -(-np.diff(bounds) // PIECE)
                piece = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
                starts = np.repeat(bounds[:-1], of) + piece * PIECE
                key = mixed(np.repeat(b.column(0).to_numpy()[i:j].view(np.uint64), of) + piece.astype(np.uint64))
                ends = np.append(starts, len(token)) * 2
                part = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(token.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key // np.uint64(ROUNDS) % np.uint64(n_cells)).astype(np.int32)), pa.array((key % np.uint64(ROUNDS)).astype(np.int32)), pa.array(key.view(np.int64)), part.cast(pa.binary())],
                    names=names,
                )
        if spelled.any():
            parts = blocks(spelled, SPELLING_BLOCK)
            none = np.zeros(parts.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(parts.num_rows), pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.int64()), parts.column(1)], names=names)

    def join(batches):
        at, held, n = None, [], 0

        def cell():
            if at[0] < 0:
                summed = sum(np.frombuffer(x, "<i8") for x in held).astype("<i8").tobytes()
                return pa.RecordBatch.from_pydict({"cell": pa.array([at[0]], pa.int32()), "round": pa.array([0], pa.int32()), "tokens": pa.array([summed], pa.binary()), "bounds": pa.array([b""], pa.binary())})
            return pa.RecordBatch.from_pydict({"cell": pa.array([at[0]], pa.int32()), "round": pa.array([at[1]], pa.int32()), "tokens": pa.array([b"".join(held)], pa.binary()), "bounds": pa.array([np.cumsum([0, *(len(x) // 2 for x in held)]).astype("<i8").tobytes()], pa.binary())})

        for b in batches:
            for c, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                # many equal rows without doc_id have one hash: no cell grows beyond what a task holds
                if held and (at != (c, r) or n > 4 * CELL and c >= 0):
                    yield cell()
                    held, n = [], 0
                at = (c, r)
                if c < 0 and held:  # sums are as large as what they add
                    t = (np.frombuffer(held.pop(), "<i8") + np.frombuffer(t, "<i8")).tobytes()
                held.append(t)
                n += len(t)
        if held:
            yield cell()

    pieces = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(cut, "cell int, round int, key long, tokens binary")
    # equal hashes are equal pieces, but for chance; then their tokens decide
    dealt = pieces.repartition(min(n_cells, 4096), "cell").sortWithinPartitions("cell", "round", "key", "tokens")
    return dealt.mapInArrow(join, "cell int, round int, tokens binary, bounds binary")


def replica(net: Network, token: np.ndarray, bounds: np.ndarray, words: int) -> int:
    """Trains on a cell; returns the number of steps."""
    near = around(token, bounds, words + 1)
    # tokens of one document would follow each other in a step
    order = np.random.default_rng(len(token)).permutation(len(token))
    for i in range(0, len(order), BATCH):
        net.step(near[order[i : i + BATCH]], token[order[i : i + BATCH]])
    return -(-len(order) // BATCH)


def train(docs: DataFrame, words: list[int], counts: list[int], total: int) -> tuple[np.ndarray, np.ndarray]:
    """The network's weights after all rounds, from all tokens of ``docs``, and the counts of the spelling."""
    start = Network(len(words))
    start.start_from(np.array(counts, np.float64), total - sum(counts))
    weights, n = start.flat, len(words)
    spelled = np.zeros(SPELLED, np.int64)
    if not total:
        return weights, spelled
    dealt = stored(cells(docs, words, total))
    for k in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(weights)

        def run(batches, shared=shared):
            summed, steps = np.zeros(len(shared.value) + 1, np.int64), 0
            for b in batches:
                for t, ends in zip(b.column(0), b.column(1), strict=True):
                    net = Network(n, shared.value)
                    own = replica(net, np.frombuffer(t.as_buffer(), "<u2").astype(np.int64), np.frombuffer(ends.as_buffer(), "<i8"), n)
                    summed[:-1] += own * np.rint(np.clip(net.flat, -64, 64) * np.float32(1 << FIXED)).astype(np.int64)
                    steps += own
            if steps:
                summed[-1] = steps
                yield blocks(summed, WEIGHTS)

        got = added(dealt.where((F.col("round") == k) & (F.col("cell") >= 0)).select("tokens", "bounds").mapInArrow(run, "block int, values binary"), WEIGHTS)
        shared.unpersist()
        if len(got):
            weights = (got[:-1] / (got[-1] * float(1 << FIXED))).astype(np.float32)
    for at, counts_ in dealt.where("cell < 0").select("cell", "tokens").collect():  # of fixed size
        at = (-1 - at) * SPELLING_BLOCK
        spelled[at : at + len(counts_) // 8] += np.frombuffer(counts_, "<i8")
    return weights, spelled


def unknown(texts: pa.Array, tokens: Tokens):
    """(first row, end row, bytes, tokens, words before each row, places of unknown words, their starts and ends, hash of
    their neighbours, hash of themselves), a run of rows at a time."""
    for i, j, data, offs in chunks(texts, RUN):
        hashes, bounds, starts, ends = word_spans(data, offs)
        token = tokens.of(hashes)
        at = np.flatnonzero(token == tokens.size)
        row = np.searchsorted(bounds, at, "right") - 1
        window = np.full(len(at), 17, np.uint64)
        for k in PLACES:
            there = (at + k >= bounds[row]) & (at + k < bounds[row + 1])
            window = window * np.uint64(0x9E3779B97F4A7C15) + np.where(there, hashes[np.clip(at + k, 0, max(0, len(hashes) - 1))], np.uint64(abs(k)))
        yield i, j, data, token, bounds, at, starts[at], ends[at], mixed(window).view(np.int64), (hashes[at] >> np.uint64(33)).astype(np.int32)


def memory(docs: DataFrame, words: list[int], places: int = 0) -> DataFrame:
    """(window, word, n): windows that occur more than once around unknown words in all documents, the word if it
    was the same each time, else null, and how often. ``places``: about how many unknown words there are; the blocks of
    windows, by the high bits of their hash, follow it. A task merges equal windows before it sends them."""
    tokens, bits = Tokens(words), max(0, (places - 1) // BLOCK).bit_length()

    def met(batches):
        for b in batches:
            for *_, window, word in unknown(b.column(0), tokens):
                rows = np.empty(len(window), SEEN)
                rows["key"], rows["n"], rows["low"], rows["high"] = window.view(np.uint64), 1, word, word
                yield rows

    def cut(batches):
        for rows in combined(met(batches), HELD):
            of = (rows["key"] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(rows), np.int32)
            at = np.flatnonzero(np.diff(of, prepend=-1))
            ends = np.append(at, len(rows)) * SEEN.itemsize
            values = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(of[at]), values.cast(pa.binary())], names=["block", "seen"])

    def repeated(rows):
        rows = rows[rows["n"] > 1]
        word = pa.array(rows["low"].copy(), pa.int32(), mask=rows["low"] != rows["high"])
        return pa.RecordBatch.from_arrays([pa.array(rows["key"].view(np.int64).copy()), word, pa.array(rows["n"].copy())], names=["window", "word", "n"])

    def join(batches):
        at, held, n = None, [], 0
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != at and held:
                    yield repeated(merged(held))
                    held, n = [], 0
                at = k
                held.append(np.frombuffer(x.as_buffer(), SEEN))
                n += len(held[-1])
                if n > 4 * BLOCK:  # windows that come again and again
                    held = [merged(held)]
                    n = len(held[0])
        if held:
            yield repeated(merged(held))

    parts = docs.select("text").mapInArrow(cut, "block int, seen binary").repartition(min(1 << bits, 4096), "block").sortWithinPartitions("block")
    return parts.mapInArrow(join, "window long, word int, n long")


def flags(known: DataFrame) -> np.ndarray:
    """Bits, some of each window that is remembered: a window whose bit is 0 isn't. Their number follows that of the
    windows up to a bound; beyond it more windows are looked for in vain, and all are still found."""
    bits = min(MOST, max(FEWEST, (FLAGS * known.count()).bit_length()))

    def run(batches):
        out = np.zeros(1 << bits - 3, np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        # no task sets a bit that another does if windows are dealt by hash, but any may set any
        width = min(len(out), WEIGHTS)
        for k in range(0, len(out), width):
            if out[k : k + width].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k // width], pa.int32()), "values": pa.array([out[k : k + width].tobytes()], pa.binary())})

    def join(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                got[k] = got[k] | x if k in got else x
        for k, x in got.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "values": pa.array([x.tobytes()], pa.binary())})

    out = np.zeros(1 << bits - 3, np.uint8)
    width = min(len(out), WEIGHTS)
    schema = "block int, values binary"
    for k, x in known.select("window").mapInArrow(run, schema).repartition("block").mapInArrow(join, schema).toLocalIterator():
        out[k * width : (k + 1) * width] = np.frombuffer(x, np.uint8)
    return out


def flagged(bits: np.ndarray, window: np.ndarray) -> np.ndarray:
    at = window.view(np.uint64) >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def row_sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[bounds[1:]] - total[bounds[:-1]]


def network_log_p(net: Network, token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    near = around(token, bounds, net.words + 1)
    return np.concatenate([net.log_p(near[k : k + BATCH], token[k : k + BATCH]) for k in range(0, len(token), BATCH)] or [np.zeros(0)]).astype(np.float64)


def score(docs: DataFrame, words: list[int], weights: np.ndarray, spelled: np.ndarray, known: DataFrame, trust: float) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_p. ``known`` is the memory, and ``trust`` the part that it has of the
    probability of an unknown word in a window that occurs elsewhere."""
    tokens = Tokens(words)
    shared = docs.sparkSession.sparkContext.broadcast((weights, spelled, flags(known)))
    names = ["row", "window", "word", "spelled", "doc_id", "n_tokens", "lp"]

    def run(batches):
        weights, spelled, bits = shared.value
        net, spell, row = Network(tokens.size, weights), Spelling(spelled), TaskContext.get().partitionId() << 40
        for b in batches:
            for i, j, data, token, bounds, at, starts, ends, window, word in unknown(b.column(1), tokens):
                lp, by_spelling = network_log_p(net, token, bounds), spell.log_p(data, starts, ends)
                # what can't be remembered is known already
                open_ = flagged(bits, window)
                lp[at[~open_]] += by_spelling[~open_]
                at, window, word, by_spelling = at[open_], window[open_], word[open_], by_spelling[open_]
                sums = row_sums(lp, bounds)
                rows = row + np.arange(j - i)
                row += j - i
                # one line for the document, anywhere, and one for each unknown word that may be remembered
                none, whose = len(at), rows[np.searchsorted(bounds, at, "right") - 1]
                lacks = lambda t: pa.nulls(j - i, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, whose])), pa.array(np.concatenate([mixed(rows.astype(np.uint64)).view(np.int64), window])), pa.concat_arrays([lacks(pa.int32()), pa.array(word)]),
                        pa.concat_arrays([lacks(pa.float32()), pa.array(by_spelling.astype(np.float32))]), pa.concat_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.nulls(none, pa.int64())]),
                        pa.concat_arrays([pa.array(np.diff(bounds).astype(np.int64)), pa.nulls(none, pa.int64())]), pa.concat_arrays([pa.array(sums), pa.nulls(none, pa.float64())]),
                    ],
                    names=names,
                )

    lines = docs.select("doc_id", "text").mapInArrow(run, "row long, window long, word int, spelled float, doc_id long, n_tokens long, lp double")
    joined = lines.join(known.select("window", F.col("word").alias("remembered"), F.lit(True).alias("met")), "window", "left")
    by_spelling = F.col("spelled").cast("double")
    remembered = F.log((1 - trust) * F.exp(by_spelling) + F.when(F.col("word") == F.col("remembered"), trust).otherwise(0.0))
    # a window that held more than one word points at none, and leaves the spelling as it is
    lp = F.when(F.col("spelled").isNull(), F.col("lp")).when(F.col("met") & F.col("remembered").isNotNull(), remembered).otherwise(by_spelling)
    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum(lp).alias("log_likelihood"))
    return summed.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_p"))


def agreement(known: DataFrame) -> float:
    """How often a window that occurs more than once held one word only, by places, with two places added for either."""
    row = known.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("same"), F.sum("n").alias("n")).first()
    return float(((row["same"] or 0) + 2) / ((row["n"] or 0) + 4))


def vocabulary(counts: DataFrame, n: int = WORDS) -> tuple[list[int], list[int]]:
    """Hashes and counts of the n most frequent words, ties to the smaller hash."""
    rows = counts.orderBy(F.desc("n"), "h").limit(n).collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def pseudo_likelihood(docs: DataFrame, use: Column | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_tokens, log_likelihood, mean_log_p.

    log_likelihood sums the log-probability of every word of the whole text given its neighbours. All is learned from
    the rows for which ``use`` holds, by default every row, repeated rows as often as they come; scores don't depend on
    the partitions of ``docs``. A text without words, or null, has 0 tokens, likelihood 0 and no mean. Very long texts
    are scored whole, in memory in proportion to the text. Without words in any text all likelihoods are 0. An empty
    table gives no rows. Other columns are ignored.
    """
    learned = docs if use is None else docs.where(use)
    counts = stored(word_counts(learned))
    words, n = vocabulary(counts)
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    known = stored(memory(learned, words, total - sum(n)))
    return score(docs, words, *train(learned, words, n, total), known, agreement(known))
