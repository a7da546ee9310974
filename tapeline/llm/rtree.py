"""Hard negatives by best-first search of R-trees packed by sort-tile-recursive.

Vectors are dealt to blocks by ranges of label and first component. A block sorts the vectors of each label by the
component of the largest spread, cuts them into slabs, sorts each slab by the next component and so on, down to leaves;
consecutive leaves share a parent, and so on up to one root. Every node has the smallest box that holds its vectors, and
from a query's weights each side of the box gives an interval of products; their sums bound the scores inside. The search
opens the nodes of the highest bounds first. It leaves out boxes outside the windows of wanted scores, boxes of unwanted
labels, and boxes below the k-th score so far or at it with larger ids only, and ends when the highest bound is strictly
below it. The queries of a batch are searched side by side, in rounds: a round opens the best node of each query, later
the best ones in proportion to what it has opened, and a node that several queries open meets them in one product of
matrices.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a leaf, children of a node, components of a block, queries of a batch, bounds held at once, rows found that
#: are held at once beyond the best.
LEAF, FAN, BLOCK, BATCH, BOUNDS, HELD = 64, 16, 1 << 20, 1024, 1 << 22, 1 << 20
POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: A negative's score is at least and at most so many hundredths of the positive's.
LOW, HIGH = 30, 90
INDEX = "dims int, keys binary, ids binary, labels binary, wide boolean, rows binary, starts binary, turn long"
FOUND = "key long, n long, id long, score long"
ANY = (-(1 << 63), (1 << 63) - 1)


def quantised(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(key, id, label, v array<long>): one row for each valid vector; key tells rows of one id apart."""
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    whole = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & F.forall(vec_col, lambda x: F.coalesce((x.cast("double") - x.cast("double")) == 0, F.lit(False)))
    return rows.where(whole).select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))


def tiles(v: np.ndarray) -> list[np.ndarray]:
    """Places of the rows of ``v`` leaf by leaf."""
    order = np.argsort(-v.var(0), kind="stable") if v.size else np.zeros(0, np.int64)

    def cut(at: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(at) // LEAF)
        if leaves <= 1:
            return [at]
        if depth == len(order):
            return [at[k : k + LEAF] for k in range(0, len(at), LEAF)]
        slabs = max(2, int(np.ceil(leaves ** (1 / (len(order) - depth)))))
        size = -(-leaves // slabs) * LEAF
        at = at[np.argsort(v[at, order[depth]], kind="stable")]
        return [x for k in range(0, len(at), size) for x in cut(at[k : k + size], depth + 1)]

    return cut(np.arange(len(v)), 0)


class Tree:
    """rows: [vector, component] in the order of the leaves; starts: first vector of each leaf, and the end. levels: from
    the leaves up (lowest, highest component, lowest, highest label, smallest id of each node)."""

    def __init__(self, keys, ids, labels, rows, starts):
        self.keys, self.ids, self.labels, self.rows, self.starts = keys, ids, labels, rows, starts
        first, level = starts[:-1], (rows, rows, labels, labels, ids)
        self.levels = []
        while not self.levels or len(self.levels[-1][0]) > 1:
            level = tuple(f.reduceat(x, first, axis=0) if len(x) else x for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum, np.minimum), level, strict=True))
            self.levels.append(tuple(x.astype(np.float64) for x in level[:2]) + level[2:])
            first = np.arange(0, len(level[0]), FAN)
        self.top = float(np.abs(rows).max(initial=0))
        self.as_float = rows.astype(np.float64)

    @classmethod
    def of(cls, keys, ids, labels, rows) -> Tree:
        leaves = [same[at] for label in np.unique(labels) for same in [np.flatnonzero(labels == label)] for at in tiles(rows[same])]
        order = np.concatenate(leaves)
        return cls(keys[order], ids[order], labels[order], rows[order], np.concatenate([[0], np.cumsum([len(x) for x in leaves])]).astype(np.int64))

    def best(self, key: int, q: np.ndarray, label: int, same: bool, window: tuple[int, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, nodes opened) of ``search`` for one query with one window."""
        low, high = (np.array([[x]], np.int64) for x in window)
        (_, _, ids, scores), opened = self.search(np.array([key]), np.asarray(q)[None], np.array([label]), same, low, high, k)
        return ids, scores, int(opened[0])

    def search(self, keys: np.ndarray, q: np.ndarray, labels: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """((query, window, id, score), nodes opened by each query): of the rows other than the query's ``keys``, of the
        same label or of other ones, with scores within a window low[query, window] to high[query, window], the k best
        by score and then smaller id, for each window."""
        dims, nodes = q.shape[1], sum(len(level[0]) for level in self.levels)
        big = np.abs(q.astype(np.float64)).max(1, initial=0) * self.top * max(1, dims)
        some, exact = max(1, BOUNDS // nodes), big < 2**53
        parts = [x[i : i + some] for x in (np.flatnonzero(exact), np.flatnonzero(~exact)) for i in range(0, len(x), some)]
        out, opened = [[np.zeros(0, np.int64)] for _ in range(4)], np.zeros(len(q), np.int64)
        for at in parts:
            slack = np.where(exact[at], 0.0, big[at] * 1e-14 * (dims + 1))
            (who, *found), opened[at] = self.side_by_side(keys[at], q[at], labels[at], same, low[at], high[at], k, bool(exact[at[0]]), slack)
            for o, x in zip(out, (at[who], *found), strict=True):
                o.append(x)
        return tuple(np.concatenate(o) for o in out), opened

    def side_by_side(self, keys, q, labels, same, low, high, k, exact: bool, slack: np.ndarray):
        """``search`` for queries whose scores are all exact in floats, or all aren't."""
        (many, width), base = low.shape, np.cumsum([0, *(len(level[0]) for level in self.levels)])
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        vectors, q = (self.as_float, q.astype(np.float64)) if exact else (self.rows, q)
        low, high = (low.astype(np.float64), high.astype(np.float64)) if exact else (low, high)
        # the least score that a window still takes: its own, later its k-th so far, and then smaller ids than that one's
        floor, last, highest = low.copy(), np.full(low.shape, ANY[1]), high.max(1)
        queue, opened = np.full((many, base[-1]), -np.inf), np.zeros(many, np.int64)
        want, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.dtype)

        def offer(depth: int, begin: int, end: int, who: np.ndarray) -> None:
            """Puts nodes of a level into the queues of those queries for which they can hold what is wanted."""
            lo, hi, lab_lo, lab_hi, least_id = (x[begin:end] for x in self.levels[depth])
            most, least = up[who] @ hi.T + down[who] @ lo.T + slack[who, None], up[who] @ lo.T + down[who] @ hi.T - slack[who, None]
            ok = np.zeros(most.shape, bool)
            for n in range(width):
                at_floor = (most == floor[who, n, None]) & (least_id <= last[who, n, None])
                ok |= ((most > floor[who, n, None]) | at_floor) & (least <= high[who, n, None])
            mine = labels[who, None]
            ok &= (lab_lo <= mine) & (lab_hi >= mine) if same else (lab_lo != mine) | (lab_hi != mine)
            queue[who, base[depth] + begin : base[depth] + end] = np.where(ok, most, -np.inf)

        def best(new: list) -> tuple[np.ndarray, ...]:
            """The k best of each window; they raise its floor."""
            want, ids, scores = (np.concatenate(x) for x in zip(*new, strict=True))
            order = np.lexsort((ids, -scores, want))
            want, ids, scores = want[order], ids[order], scores[order]
            rank = np.arange(len(want)) - np.searchsorted(want, want)
            want, ids, scores, rank = (x[rank < k] for x in (want, ids, scores, rank))
            full = rank == k - 1
            floor.reshape(-1)[want[full]], last.reshape(-1)[want[full]] = scores[full], ids[full]
            return want, ids, scores

        offer(len(self.levels) - 1, 0, 1, np.arange(many))
        take = 1
        while True:
            lowest = floor.min(1)
            queue[queue < lowest[:, None]] = -np.inf
            live = np.flatnonzero(queue.max(1) > -np.inf)
            if not len(live):
                break
            n = min(take, queue.shape[1])
            node = np.argpartition(-queue[live], n - 1, axis=1)[:, :n].ravel()
            who = np.repeat(live, n)
            node, who = (x[queue[who, node] > -np.inf] for x in (node, who))
            queue[who, node] = -np.inf
            opened += np.bincount(who, minlength=many)
            order = np.argsort(node, kind="stable")
            node, who = node[order], who[order]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            new, held = [(want, ids, scores)], 0
            for one, who in zip(node[first].tolist(), np.split(who, first[1:]), strict=True):
                if one >= base[1]:
                    depth = int(np.searchsorted(base, one, "right")) - 1
                    at = (one - base[depth]) * FAN
                    offer(depth - 1, at, min(at + FAN, len(self.levels[depth - 1][0])), who)
                    continue
                at = slice(self.starts[one], self.starts[one + 1])
                got = q[who] @ vectors[at].T
                i, r = np.nonzero((got >= lowest[who, None]) & (got <= highest[who, None]))
                score, r, i = got[i, r], r + at.start, who[i]
                ok = (floor[i] < score[:, None]) | (floor[i] == score[:, None]) & (last[i] >= self.ids[r, None])
                ok &= high[i] >= score[:, None]
                ok &= ((self.keys[r] != keys[i]) & ((self.labels[r] == labels[i]) == same))[:, None]
                i_, n = np.nonzero(ok)
                new.append((i[i_] * width + n, self.ids[r[i_]], score[i_]))
                held += len(i_)
                if held > HELD:
                    new, held = [best(new)], 0
                    lowest = floor.min(1)
            want, ids, scores = best(new)
            take = 1 + int(opened.max()) // 2
        return (want // width, want % width, ids, scores.astype(np.int64)), opened

    def row(self) -> tuple:
        wide = self.top >= 2**31 - 1
        return self.rows.shape[1], *(x.astype("<i8").tobytes() for x in (self.keys, self.ids, self.labels)), wide, self.rows.astype("<i8" if wide else "<i4").tobytes(), self.starts.astype("<i8").tobytes()

    @classmethod
    def read(cls, dims, keys, ids, labels, wide, rows, starts) -> Tree:
        keys, ids, labels, starts = (np.frombuffer(x, "<i8") for x in (keys, ids, labels, starts))
        return cls(keys, ids, labels, np.frombuffer(rows, "<i8" if wide else "<i4").reshape(len(keys), dims).astype(np.int64), starts)


def packed(batches):
    """Trees of vectors of equal length, of at most ``BLOCK`` components but one vector at least, from a partition's rows.
    Their turns, by which they are dealt to tasks, start with the partition's number and go up by one."""
    from pyspark import TaskContext

    names, held, turn = [x.split()[0] for x in INDEX.split(", ")], {}, itertools.count(TaskContext.get().partitionId())

    def put(parts):
        row = *Tree.of(*parts).row(), next(turn)
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.int32(), *[pa.binary()] * 3, pa.bool_(), *[pa.binary()] * 2, pa.int64()), strict=True)], names=names)

    for b in batches:
        keys, ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        lengths = np.diff(b.column(3).offsets.to_numpy())
        flat, at = b.column(3).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
        for dims in np.unique(lengths):
            some, size = np.flatnonzero(lengths == dims), max(1, BLOCK // max(1, int(dims)))
            got = [keys[some], ids[some], labels[some], flat[(at[some][:, None] + np.arange(dims)).ravel().astype(np.int64)].reshape(len(some), dims)]
            if dims in held:
                got = [np.concatenate(x) for x in zip(held[dims], got, strict=True)]
            while len(got[0]) >= size:
                yield put([x[:size] for x in got])
                got = [x[size:] for x in got]
            held[dims] = got
    for parts in held.values():
        if len(parts[0]):
            yield put(parts)


def indexed(valid: DataFrame, components: int) -> DataFrame:
    """The trees, stored. Ranges of label and first component bring similar vectors together; the row's own key splits
    what is equal, so no vector, however frequent, fills a partition of its own. Since a query gets up to k rows a
    block, few vectors aren't dealt to more blocks than there are cores."""
    parts = max(valid.sparkSession.sparkContext.defaultParallelism, -(-components // BLOCK))
    near = valid.repartitionByRange(parts, F.size("v"), "label", F.get("v", F.lit(0)), "key").coalesce(parts)
    return stored(near.select("key", "id", "label", "v").mapInArrow(packed, INDEX))


def asked_of(batch: pa.StructArray, dims: int) -> tuple[np.ndarray, ...]:
    """(keys, vectors, labels, lowest, highest score of each window) of a batch of queries. Windows that a query lacks
    are empty ones."""
    keys, labels = (batch.field(c).to_numpy(zero_copy_only=False) for c in ("key", "label"))
    vectors = batch.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(keys), dims)
    held = batch.field("windows")
    there = np.diff(held.offsets.to_numpy())
    there = np.arange(there.max()) < there[:, None]
    low, high = np.full(there.shape, ANY[1]), np.full(there.shape, ANY[0])
    for side, name in ((low, "low"), (high, "high")):
        side[there] = held.flatten().field(name).to_numpy(zero_copy_only=False)
    return keys, vectors, labels, low, high


def copies(index: DataFrame, many: int, rows: int) -> int:
    """To how many parts of the index the ``many`` queries go: no more than shuffles have or there are blocks, and beyond
    the number of cores no more than make the copies together a quarter as many vectors as the ``rows``: each part also gives up to
    k rows a query and window."""
    spark = index.sparkSession
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), index.count(), max(spark.sparkContext.defaultParallelism, rows // max(1, 4 * many))))


def searched(index: DataFrame, queries: DataFrame, batches: int, parts: int, same: bool, k: int) -> DataFrame:
    """(key, n, id, score): for each of ``queries`` (key, label, v, windows array<struct<low, high>>) and the n-th of its
    windows up to k best of every block. Every one of the ``batches`` of queries goes to each of the ``parts`` of the
    index: the stated query set against all rows, in blocks. A part gets its queries first and then its trees, each once;
    no join is there that would repeat the trees or broadcast the copies, which Spark takes for as small as the queries."""
    batch = queries.groupBy(F.pmod(F.xxhash64("key"), F.lit(batches)).alias("batch"), F.size("v").alias("dims")).agg(F.collect_list(F.struct("key", "label", "v", "windows")).alias("queries"))
    batch = batch.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("to"), "dims", "queries")
    names = [x.split()[0] for x in INDEX.split(", ")][:-1]
    both = index.select(F.pmod("turn", F.lit(parts)).cast("int").alias("to"), *names).unionByName(batch, allowMissingColumns=True)
    met = both.repartition("to").sortWithinPartitions("to", "dims", F.col("queries").isNull()).select("to", *names, "queries")

    def run(batches):
        part, asked = None, []
        for b in batches:
            for i in range(b.num_rows):
                to, *held = (b.column(c)[i].as_py() for c in range(1 + len(names)))
                if part != (to, held[0]):
                    part, asked = (to, held[0]), []
                some = b.column(1 + len(names))[i]
                if some.is_valid:
                    asked.append([np.array(x) for x in asked_of(some.values, held[0])])  # copies, else the batch stays
                    continue
                tree = Tree.read(*held)
                for keys, vectors, labels, low, high in asked:
                    (who, n, ids, scores), _ = tree.search(keys, vectors, labels, same, low, high, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys[who], n, ids, scores)], names=[x.split()[0] for x in FOUND.split(", ")])

    return met.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "n").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``; an anchor's positives are its best other rows of the same
    label; a pair's negatives are the best rows of other labels with low * positive <= 100 * negative <= high *
    positive. Ties go to smaller ids. Rows without id or label, and vectors that are null or hold null, NaN or infinite
    components, take no part. Rows that repeat an id are vectors of their own. Vectors meet those of their own length
    only; scores must fit 64 bits. A negative positive score has no negatives, a score of 0 those of score 0. Other
    columns are ignored; an empty table gives no rows.
    """
    valid = stored(quantised(rows, id_col, vec_col, label, scale))
    anchor = F.col("id") % every == 0
    total, many, components = valid.agg(F.count("*"), F.count_if(anchor), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    anchors, batches = valid.where(anchor), max(1, -(-many // BATCH))
    index = indexed(valid, components)
    parts = copies(index, many, total)
    whole = F.array(F.struct(F.lit(ANY[0]).alias("low"), F.lit(ANY[1]).alias("high")))
    near = ranked(searched(index, anchors.withColumn("windows", whole), batches, parts, True, positives), positives)
    # at most ``positives`` of each anchor
    pairs = stored(near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("pairs")))
    asked = anchors.join(pairs, "key")
    # the smallest and largest whole scores of the window: x - pmod(x, 100) and x + pmod(-x, 100) are divisible
    hundredths = lambda x: F.call_function("div", x, F.lit(100))
    limits = lambda p: F.struct(hundredths(p["positive_score"] * low + F.pmod(-p["positive_score"] * low, F.lit(100))).alias("low"), hundredths(p["positive_score"] * high - F.pmod(p["positive_score"] * high, F.lit(100))).alias("high"))
    found = ranked(searched(index, asked.withColumn("windows", F.transform("pairs", limits)), batches, parts, False, negatives), negatives)
    pair = F.get("pairs", F.col("n").cast("int"))
    named = found.join(asked.select("key", F.col("id").alias("anchor_id"), "pairs"), "key")
    return named.select("anchor_id", pair["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), pair["positive_score"].alias("positive_score"), F.col("score").alias("negative_score"))
