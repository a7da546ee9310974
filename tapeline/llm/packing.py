"""Packing documents into training sequences: vector bin packing by the dot-product heuristic.

A piece of a document takes tokens, a segment and loss-bearing tokens of its sequence. A sequence is opened with
the largest piece at hand and then gets, again and again, the piece that fits and whose demand has the largest
dot product with what is left of the three limits. When none fits, the best one is cut to fill what is left. A
sequence that still isn't full is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
END = 1
LENGTH = 2048
MAX_SEGMENTS = 16
#: Pieces among which the heuristic chooses, words that a tokenizer remembers, and their most bytes.
WINDOW = 1024
MEMORY, LONGEST = 300_000, 64
#: Bytes of texts that are encoded at once, word pieces that are remembered, and the most bytes of them and their ids.
RUN, PIECES, HELD = 1 << 20, 400_000, 16 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable in Latin-1, else the next from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


#: The normaliser and the splits of ``TOKENIZER``. They keep to words between ASCII white space, lower-case
#: Latin letters and never put letters and marks in one piece. Texts go whole to a tokenizer that has others.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(tokenizer) -> bool:
    """Whether words can be encoded one by one: for any other tokenizer, only whole texts give its ids."""
    spec = json.loads(tokenizer.to_str())
    return spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLITS and all(t["content"].startswith("<|") for t in spec["added_tokens"])


class Words(dict):
    """From a word, as bytes, to its ids as little-endian 32-bit bytes. Words are what ASCII white space separates:
    the pieces of a tokenizer for which ``by_words`` holds never cross it. Long words aren't remembered."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.letters, self.direct = tokenizer, byte_letters(), by_words(tokenizer)
        #: A word of Latin letters with marks around it: letters and marks are never one piece, normalisation
        #: leaves them as they are but for case, so a word is its parts, and its letters can go to the tokenizer's
        #: model directly.
        self.split = re.compile(r"([.,;:!?*#&%$()|]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#&%$()|]*)").fullmatch

    def encode(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def letters_of(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        return b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled))

    def __missing__(self, word: bytes) -> bytes:
        m = self.split(word.decode())
        if not m:
            out = self.encode(word)
        elif (core := m[2].lower()) == m[0]:
            out = self.letters_of(core)
        else:
            out = b"".join([self[part.encode()] for part in (m[1], core, m[3]) if part])
        if len(word) <= LONGEST:
            self[word] = out
        return out

    def ids(self, text: bytes) -> bytes:
        if len(self) > MEMORY:
            self.clear()
        if not self.direct or b"<|" in text:  # special tokens may hold or touch anything
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


#: Of each Latin-1 character: its lower case, and its kind for ``SPLITS``: white space, letter, number or another.
LOWER = bytes(c + 32 if 65 <= c <= 90 or 192 <= c <= 222 and c != 215 else c for c in range(256))
SPACE, LETTER, NUMBER, OTHER = range(4)
KIND = bytes(SPACE if c in b"\t\n\v\f\r \x85\xa0" else LETTER if chr(c).isalpha() else NUMBER if chr(c).isnumeric() else OTHER for c in range(256))
#: The pieces that begin with an apostrophe. One after another mark belongs to the marks before it.
SHORT = re.compile(rb"'(?:s|t|re|ve|m|ll|d)")


class Pieces(dict):
    """From a word piece, as lower-case Latin-1 bytes, to its number, for many texts at once: their characters are told
    apart by kind, each distinct piece of a run is looked up once, and new ones go to the model together. Texts with
    characters beyond Latin-1, for which ``by_words`` doesn't hold or with special tokens go to ``Words``."""

    def __init__(self, words: Words):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        model, there = words.tokenizer.model, words.tokenizer.get_vocab(with_added_tokens=False)
        self.words, self.plain = words, Tokenizer(model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # the end of a piece shows in its last id, if no letter is unknown
        self.direct = words.direct and getattr(model, "end_of_word_suffix", None) == "</w>" and all(c in there and c + "</w>" in there for c in words.letters)
        self.last = np.zeros(max(there.values(), default=0) + 1, bool)
        self.last[[n for t, n in there.items() if t.endswith("</w>")]] = True
        # spaces are only between pieces
        self.letters = "".join(" " if n == 32 else c for n, c in enumerate(words.letters))

        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new, self.flat, self.counts, self.held = [], np.zeros(0, "<u4"), np.zeros(0, np.int32), 0

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        number = self[piece] = len(self)
        return number

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; ``flat`` and ``counts`` get the ids of new ones."""
        if len(self) > PIECES or self.held > HELD:
            self.forget()
        at = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1].tolist()
        raw = pieces.buffers()[2].to_pybytes()
        out = np.fromiter(map(self.__getitem__, [raw[a:b] for a, b in itertools.pairwise(at)]), np.int64, len(pieces))
        flat, counts = [self.flat], [self.counts]
        for k in range(0, len(self.new), 4000):
            some = codecs.charmap_decode(b" ".join(self.new[k : k + 4000]).decode("latin-1").encode(), "strict", self.letters)[0]
            flat.append(np.array(self.plain.encode(some, add_special_tokens=False).ids, "<u4"))
            counts.append(np.diff(np.flatnonzero(self.last[flat[-1]]), prepend=-1).astype(np.int32))
        self.held += sum(map(len, self.new)) + sum(x.nbytes for x in flat[1:])
        self.new, self.flat, self.counts = [], np.concatenate(flat), np.concatenate(counts)
        return out

    def run(self, texts: list[bytes]) -> list[bytes]:
        """The ids of Latin-1 texts, as little-endian 32-bit bytes."""
        joined = b"\n".join(texts).translate(LOWER)
        kind = np.frombuffer(joined.translate(KIND), np.uint8)
        there = kind != SPACE
        if not there.any():
            return [b""] * len(texts)
        first = (np.diff(kind, prepend=np.uint8(SPACE)) != 0) & there | (kind == NUMBER)
        for m in SHORT.finditer(joined):
            if m.start() and kind[m.start() - 1] == OTHER:
                continue
            first[m.start() + 1] = False
            first[m.end() : m.end() + 1] = there[m.end() : m.end() + 1]
        starts = np.append(np.flatnonzero(first[there]), there.sum()).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(np.frombuffer(joined, np.uint8)[there])]).dictionary_encode()
        which = self.numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        counts = self.counts[which]
        before = np.append(0, np.cumsum(counts, dtype=np.int64))
        at = np.repeat((np.cumsum(self.counts) - self.counts)[which] - before[:-1], counts)
        at += np.arange(before[-1])
        out = self.flat[at].tobytes()
        # the first piece of each text, and one past the last one
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = (4 * before[np.searchsorted(np.flatnonzero(first), begin)]).tolist()
        return [out[a:b] for a, b in itertools.pairwise(cut)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts. Long ones are encoded in parts between white space."""
        out, mine = [b""] * len(texts), []
        for n, text in enumerate(texts):
            try:
                if not self.direct or b"<|" in text:
                    raise UnicodeError
                mine.append((n, text if text.isascii() else text.decode().encode("latin-1")))
            except UnicodeError:
                out[n] = self.words.ids(text)
        some, size = [], 0
        for n, text in [*mine, (None, b"")]:
            if n is None or size + len(text) > RUN:
                for k, x in zip([k for k, _ in some], self.run([x for _, x in some]), strict=True):
                    out[k] += x
                some, size = [], 0
            if n is not None:
                *parts, text = between(text)
                for x in parts:
                    out[n] += self.run([x])[0]
                some.append((n, text))
                size += len(text)
        return out


def between(text: bytes):
    """A text in parts of about ``RUN`` bytes at most, cut after spaces or line feeds; longer ones, if it has none."""
    at = 0
    while len(text) - at > RUN:
        to = max(text.rfind(c, at, at + RUN) for c in (b" ", b"\n")) + 1
        if to <= at:
            to = min((k + 1 for k in (text.find(c, at + RUN) for c in (b" ", b"\n")) if k >= 0), default=len(text))
        yield text[at:to]
        at = to
    yield text[at:]


class Piece:
    __slots__ = ("doc", "ids", "start", "length", "tokens", "loss_from")

    def __init__(self, doc, ids, start, length, tokens, loss_from):
        self.doc, self.ids, self.start, self.length, self.tokens, self.loss_from = doc, ids, start, length, tokens, loss_from

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        one = Piece(self.doc, self.ids, self.start, n, self.tokens, self.loss_from)
        return one, Piece(self.doc, self.ids, self.start + n, self.length - n, self.tokens, self.loss_from)

    def most(self, tokens: int, loss: int) -> int:
        """The longest head of at most so many tokens and loss-bearing tokens."""
        free = max(0, self.loss_from - self.start)
        return min(self.length, tokens, free + loss)


class Packer:
    """Sequences from pieces as they come. Holds about ``WINDOW`` pieces at a time."""

    def __init__(self, length: int, segments: int, loss: int, first_id: int):
        self.cap = np.array([length, segments, loss], float)
        self.pieces: list[Piece] = []
        self.next, self.out = first_id, []

    def add(self, doc, ids: bytes, loss_from: int) -> None:
        n = len(ids) // 4
        rest = Piece(doc, ids, 0, n, n, loss_from)
        length, _, loss = map(int, self.cap)
        while rest.length >= length and rest.most(length, loss) == length:
            one, rest = rest.cut(length)
            self.close([one])
        while rest.length:
            if (n := rest.most(length, loss)) < rest.length:
                one, rest = rest.cut(n)
                self.pieces.append(one)
            else:
                self.pieces.append(rest)
                break
        if len(self.pieces) >= 2 * WINDOW:
            self.pack(WINDOW)

    def pack(self, keep: int) -> None:
        """Fills sequences until at most ``keep`` pieces are left."""
        alive = self.pieces
        demand = np.array([(p.length, 1, p.loss) for p in alive], float).reshape(-1, 3)
        share = demand / self.cap
        there = np.ones(len(alive), bool)
        count = len(alive)
        while count > keep:
            left, got = self.cap.copy(), []
            while count and left[0] > 0 and left[1] > 0:
                fits = there & (demand[:, 0] <= left[0]) & (demand[:, 2] <= left[2])
                score = share @ (left / self.cap)
                if fits.any():
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    got.append(alive[k])
                    left -= demand[k]
                    there[k] = False
                    count -= 1
                    continue
                k = int(np.argmax(np.where(there, score, -1.0)))
                if not (n := alive[k].most(int(left[0]), int(left[2]))):
                    break
                one, alive[k] = alive[k].cut(n)
                got.append(one)
                left -= (one.length, 1, one.loss)
                demand[k] = alive[k].length, 1, alive[k].loss
                share[k] = demand[k] / self.cap
            self.close(got)
        self.pieces = [p for p, t in zip(alive, there, strict=True) if t]

    def close(self, got: list[Piece]) -> None:
        total = sum(p.length for p in got)
        while total:
            size = min(int(self.cap[0]), 1 << (total.bit_length() - 1))
            if total == int(self.cap[0]):
                size = total
            total -= size
            offset = 0
            while offset < size:
                one = got.pop(0)
                if one.length > size - offset:
                    one, rest = one.cut(size - offset)
                    got.insert(0, rest)
                self.out.append((one, self.next, offset))
                offset += one.length
            self.next += 1


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, segments: int = MAX_SEGMENTS, loss: int | None = None, prompt_tokens: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    tokenizer: path of a ``tokenizers`` file. segments, loss: limits of a sequence beside its length. prompt_tokens:
    a column with the number of leading tokens that bear no loss (null: none). A null text is empty; a document
    always has the closing id, so each gets a piece at least. Rows of one doc_id, and equal rows, are packed each by
    itself. Very long texts are cut as they come. An empty table gives no rows. Other columns are ignored.
    Nothing is shuffled; a sequence's pieces come from one partition, whose number is the high part of its id.
    """
    limit = loss or length
    schema = SCHEMA + (", ids binary" if with_ids else "")
    prompt = F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(0)) if prompt_tokens else F.lit(0).cast("long")

    def run(batches):
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        pieces = Pieces(Words(Tokenizer.from_file(tokenizer)))
        packer = Packer(length, segments, limit, TaskContext.get().partitionId() << 33)
        end = np.array([END], "<u4").tobytes()

        def rows():
            out, packer.out = packer.out, []
            if not out:
                return
            parts = [p.ids[4 * p.start : 4 * (p.start + p.length)] for p, _, _ in out]
            cols = [[p.doc for p, _, _ in out], [p.start for p, _, _ in out], [p.length for p, _, _ in out], [zlib.crc32(x) for x in parts], [p.tokens for p, _, _ in out], [s for _, s, _ in out], [o for _, _, o in out]]
            names = [x.split()[0] for x in schema.split(", ")]
            arrays = [pa.array(c, pa.int64()) for c in cols] + ([pa.array(parts, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = np.flatnonzero(np.diff(size // RUN, prepend=-1))
            for k, to in itertools.pairwise([*first.tolist(), len(size)]):
                some = b.slice(k, to - k)
                texts = [text or b"" for text in some.column(1).to_pylist()]
                for doc, ids, n in zip(some.column(0).to_pylist(), pieces.ids(texts), some.column(2).to_pylist(), strict=True):
                    packer.add(doc, ids + end, n)
                    if len(packer.out) > 4096:
                        yield from rows()
            yield from rows()
        packer.pack(0)
        yield from rows()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), prompt.alias("n")).mapInArrow(run, schema)
