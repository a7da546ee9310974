"""Exact top-k search over an impact-ordered, score-at-a-time index.

The index is built once and stored. Vectors are dealt to blocks; for each dimension a block holds its postings
(vector, value) in descending order of quantised impact, cut into segments of equal quantised impact, with the largest
impact of each segment. A query meets a block alone: in rounds of falling thresholds it takes from each dimension the
segments whose impact times the query's weight reaches the threshold and adds them to the scores. What is left can add
no more than the next segment's impact times the weight, summed over dimensions. A round ends the search on proof: the
k best so far are scored exactly, no vector whose score and bound stay below the k-th of them can be a member, and
scoring all others exactly costs less than going on. Those possible members are then scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 5
SCALE = 256
#: Components of a block of the index, and of a batch of queries.
BLOCK, BATCH = 1 << 20, 1 << 14
#: Quantised impacts other than zero.
LEVELS = 16
#: Rounds add segments down to these parts of the largest product of impact and weight.
ROUNDS = (0.5, 0.35, 0.25, 0.18, 0.13, 0.09, 0.06, 0.04, 0.02, 0.0)
PACKED = "part int, dims int, keys binary, ids binary, values binary"
INDEX = "part int, dims int, keys binary, ids binary, width int, rows binary, postings binary, values binary, starts binary, uppers binary"


def quantised(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(key, id, v array<long>): one row for each valid vector; key tells rows of one id apart."""
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    whole = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: F.coalesce((x.cast("double") - x.cast("double")) == 0, F.lit(False)))
    return rows.where(whole).select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), v.alias("v"))


def packed(cells: int):
    """Blocks of vectors of equal length, of at most ``cells`` components but one vector at least, from each partition's rows."""

    def pack(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def block(dims, *arrays):
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "dims": pa.array([dims], pa.int32()), **{n: [x.astype("<i8").tobytes()] for n, x in zip(("keys", "ids", "values"), arrays, strict=True)}})

        for b in batches:
            keys, ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            lengths = np.diff(v.offsets.to_numpy())
            flat, at = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
            for dims in np.unique(lengths):
                rows, size = np.flatnonzero(lengths == dims), max(1, cells // max(1, int(dims)))
                got = [keys[rows], ids[rows], flat[(at[rows][:, None] + np.arange(dims)).ravel()].reshape(len(rows), dims)]
                if dims in held:
                    got = [np.concatenate(x) for x in zip(held[dims], got, strict=True)]
                while len(got[0]) >= size:
                    yield block(dims, *(x[:size] for x in got))
                    got = [x[size:] for x in got]
                held[dims] = got
        for dims, got in held.items():
            if len(got[0]):
                yield block(dims, *got)

    return pack


class Block:
    """Vectors with their postings by dimension, in descending order of impact.

    rows: [vector, dimension]; postings, values: [dimension, place]; starts: [dimension, level] first place below that
    many levels from the top; uppers: [dimension, level] the largest impact from there on, 0 at the end."""

    def __init__(self, keys, ids, rows, postings, values, starts, uppers):
        self.keys, self.ids, self.rows, self.postings, self.values, self.starts, self.uppers = keys, ids, rows, postings, values, starts, uppers

    @classmethod
    def of(cls, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Block:
        impact = np.abs(rows.T.astype(np.float64))
        top = impact.max(initial=0.0)
        level = np.ceil(impact * (LEVELS / top)) if top else np.zeros(impact.shape)
        postings = np.argsort(-level, axis=1, kind="stable").astype(np.int32)
        level = np.take_along_axis(level, postings, 1)
        starts = np.stack([(level > LEVELS - k).sum(1) for k in range(LEVELS + 1)], axis=1).astype(np.int32)
        by_place = np.concatenate([np.take_along_axis(impact, postings, 1), np.zeros((len(impact), 1))], axis=1)
        # the largest from each place on
        rest = np.maximum.accumulate(by_place[:, ::-1], axis=1)[:, ::-1]
        return cls(keys, ids, rows, postings, np.take_along_axis(rows.T, postings, 1), starts, np.take_along_axis(rest, starts, 1))

    def best(self, key: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the k best for the query with this key and vector, exactly, by score and then smaller id,
        and how many postings and components were read."""
        n, dims = self.rows.shape
        weight = np.abs(q.astype(np.float64))
        products = weight[:, None] * self.uppers
        top, read = products.max(initial=0.0), 0
        slack = 1e-12 * np.sqrt((weight * weight).sum()) * np.sqrt((self.uppers[:, 0] ** 2).sum()) * max(1, dims)
        scores, other = np.zeros(n), self.keys != key
        done, level, possible = np.zeros(dims, np.int64), np.zeros(dims, np.int64), np.flatnonzero(other)
        if len(possible) > k and top:
            for part in ROUNDS:
                # segments fall in impact, so those that reach the threshold come first
                level = np.maximum(level, (products[:, :LEVELS] >= part * top).sum(1) if part else LEVELS)
                ends = self.starts[np.arange(dims), level]
                for d in np.flatnonzero(ends > done):
                    at = self.postings[d, done[d] : ends[d]]
                    scores[at] += float(q[d]) * self.values[d, done[d] : ends[d]]
                read += int((ends - done).sum())
                done = ends.astype(np.int64)
                bound = products[np.arange(dims), level].sum() + slack
                some = scores[possible]
                lead = possible[np.argpartition(-some, k - 1)[:k]]
                read += k * dims
                worst = (self.rows[lead].astype(np.int64) @ q).min()
                possible = possible[some + bound >= worst - slack]
                if len(possible) * dims <= self.starts[:, LEVELS].sum() - done.sum() or not part:
                    break
        exact = self.rows[possible].astype(np.int64) @ q
        read += len(possible) * dims
        order = np.lexsort((self.ids[possible], -exact))[:k]
        return possible[order], exact[order], read

    def row(self) -> tuple:
        wide = self.rows.size and np.abs(self.rows).max() >= 2**31 - 1
        kind = "<i8" if wide else "<i4"
        return self.keys.astype("<i8").tobytes(), self.ids.astype("<i8").tobytes(), 8 if wide else 4, self.rows.astype(kind).tobytes(), self.postings.astype("<i4").tobytes(), self.values.astype(kind).tobytes(), self.starts.astype("<i4").tobytes(), self.uppers.astype("<f8").tobytes()

    @classmethod
    def read(cls, dims: int, keys, ids, width, rows, postings, values, starts, uppers) -> Block:
        kind = f"<i{width}"
        keys, ids = np.frombuffer(keys, "<i8"), np.frombuffer(ids, "<i8")
        at = lambda x, kind: np.frombuffer(x, kind).reshape(dims, -1) if dims else np.zeros((0, LEVELS + 1), kind)
        return cls(keys, ids, np.frombuffer(rows, kind).reshape(len(keys), dims), at(postings, "<i4"), at(values, kind), at(starts, "<i4"), at(uppers, "<f8"))


def indexed(batches):
    """Blocks of vectors become blocks of the index."""
    for b in batches:
        for i in range(b.num_rows):
            part, dims, keys, ids, values = (b.column(c)[i].as_py() for c in range(5))
            keys, ids = np.frombuffer(keys, "<i8"), np.frombuffer(ids, "<i8")
            row = Block.of(keys, ids, np.frombuffer(values, "<i8").reshape(len(keys), dims)).row()
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dims], pa.int32()), *(pa.array([x], pa.int32() if n == "width" else pa.binary()) for n, x in zip(names[2:], row, strict=True))], names=names)


def top_k(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k highest scores among all
    other rows.

    Vectors that are null, or hold null, NaN or infinite components, take no part, nor do rows without id. Rows that
    repeat an id are vectors of their own, each a candidate for the others; if their id is divisible, each is a query.
    Vectors meet those of their own length only. Ties go to smaller ids. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = rows.sparkSession
    valid = stored(quantised(rows, id_col, vec_col, scale))
    index = stored(valid.mapInArrow(packed(BLOCK), PACKED).mapInArrow(indexed, INDEX))
    queries = valid.where(F.col("id") % every == 0).mapInArrow(packed(BATCH), PACKED)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # every batch of queries goes to every partition of the index: the stated query set against all rows, in blocks
    parts = index.withColumn("to", F.pmod(F.xxhash64("part", "keys"), F.lit(n)).cast("int"))
    batches = queries.select("dims", F.col("keys").alias("q_keys"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values")).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    names = [x.split()[0] for x in INDEX.split(", ")[1:]]
    met = parts.join(batches, ["to", "dims"]).select(*names, "q_keys", "q_ids", "q_values")

    def search(it):
        last, block = None, None
        for b in it:
            for i in range(b.num_rows):
                dims, *held, q_keys, q_ids, q_values = (b.column(c)[i].as_py() for c in range(b.num_columns))
                if held[0] != last:
                    last, block = held[0], Block.read(dims, *held)
                q_keys = np.frombuffer(q_keys, "<i8")
                out = [[] for _ in range(4)]
                for key, qid, q in zip(q_keys, np.frombuffer(q_ids, "<i8"), np.frombuffer(q_values, "<i8").reshape(len(q_keys), dims), strict=True):
                    at, scores, _ = block.best(key, q, k)
                    for o, x in zip(out, (np.full(len(at), key), np.full(len(at), qid), block.ids[at], scores), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=["key", "query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
