"""From raw scores to judged thresholds: cross-fitted logistic scores, isotonic calibration, thresholds under a bound on
false alarms, the ladder of other thresholds, and the last checks of a run.

Nothing here gathers rows. Fits meet the driver as matrices of twelve by twelve, a month each; isotonic blocks as what
partitions have pooled; thresholds as counts by month and rounded score; resampled months as a table of (replicate, month).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import stored
from .prefix import running

#: Blocks of an isotonic fit that are joined by broadcast, and bins of scores by which more of them are joined.
BROADCAST_ROWS, BINS = 100_000, 1024

# ---- expanding logistic scores


def month_sums(names: list[str], weights: np.ndarray, months: list[str]):
    """For the fit of each month: gradient, Hessian and loss of its weights over a partition's rows of earlier months.

    Rows hold a bias as their last number; one product of matrices gives all months' scores of a batch, and another their
    Hessians, as weighted sums of the rows' squares."""
    size = len(names) + 1
    upper = np.triu_indices(size)

    def run(batches):
        grad, hess = np.zeros((len(months), size)), np.zeros((len(months), len(upper[0])))
        loss = np.zeros(len(months))
        for b in batches:
            x = np.column_stack([*(b.column(n).to_numpy(zero_copy_only=False) for n in names), np.ones(b.num_rows)])
            y = b.column("y").to_numpy(zero_copy_only=False)[:, None]
            later = b.column("place").to_numpy(zero_copy_only=False)[:, None] < np.arange(len(months))
            z = x @ weights.T
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            grad += np.where(later, p - y, 0).T @ x
            hess += np.where(later, p * (1 - p), 0).T @ (x[:, upper[0]] * x[:, upper[1]])
            loss += np.where(later, np.logaddexp(0, np.where(y > 0, -z, z)), 0).sum(0)
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(months)), pa.int32()), "sums": list(np.column_stack([grad, hess, loss]))})

    return run


def expanding_weights(rows: DataFrame, names: list[str], least: int = 80, c: float = 1.0, rounds: int = 40) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(months, weights with the intercept last, whether each month has a fit) from ``rows`` (month, y, names): each month's
    fit to all months before it, minimising |w|^2 / 2 + c * log loss with a free intercept, by Newton's steps for all
    months at once. A step that makes a month's loss greater is halved."""
    known = rows.groupBy("month").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).orderBy("month").collect()  # a row a month
    months, size = [r["month"] for r in known], len(names) + 1
    n, hits = (np.cumsum([0.0, *[r[k] for r in known]])[:-1] for k in ("n", "hits"))
    fits = (n >= least) & (hits > 0) & (hits < n)
    w = np.zeros((len(months), size))
    if not fits.any():
        return months, w, fits
    spark = rows.sparkSession
    # earlier months are the smaller places
    placed = stored(rows.join(spark.createDataFrame(list(enumerate(months)), "place int, month string"), "month").select("place", F.col("y").cast("double").alias("y"), *names))
    ridge, upper = np.append(np.ones(size - 1), 0.0), np.triu_indices(size)
    best, move, cost, part = w.copy(), np.zeros_like(w), np.full(len(months), np.inf), np.ones(len(months))
    running_, left = fits.copy(), rounds
    while running_.any() and left:
        left -= 1
        total = placed.mapInArrow(month_sums(names, w, months), "place int, sums array<double>").groupBy("place", F.lit(1)).agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(size + len(upper[0]) + 1)]).alias("sums")).collect()
        sums = np.zeros((len(months), size + len(upper[0]) + 1))
        for r in total:
            sums[r["place"]] = r["sums"]
        now = 0.5 * (ridge * w * w).sum(1) + c * sums[:, -1]
        for m in np.flatnonzero(running_):
            if now[m] > cost[m] and part[m] > 1e-6:
                part[m] /= 2
            else:
                done = np.abs(w[m] - best[m]).max() < 1e-10 and math.isfinite(cost[m])
                hess = np.zeros((size, size))
                hess[upper] = sums[m, size:-1]
                hess = np.diag(ridge) + c * (hess + np.triu(hess, 1).T)
                best[m], cost[m], part[m] = w[m], now[m], 1.0
                move[m] = np.linalg.lstsq(hess, ridge * w[m] + c * sums[m, :size], rcond=None)[0]
                running_[m] = not done and np.abs(move[m]).max() >= 1e-10
            if running_[m]:
                w[m] = best[m] - part[m] * move[m]
    return months, best, fits


def crossfit(rows: DataFrame, names: list[str], label: str = "label", least: int = 80) -> DataFrame:
    """``rows`` of labelled months with p_raw, from the fit to the months before, and train_months, how many these are.
    Rows without label, or with a missing or infinite number, take no part; months whose past has fewer than ``least``
    rows, or one class only, give none."""
    finite = F.forall(F.array(*names), lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    labelled = rows.where(F.col(label).isNotNull())
    fit = stored(labelled.where(finite).select("month", F.col(label).cast("boolean").cast("int").alias("y"), *names))
    months, weights, fits = expanding_weights(fit, names, least)
    every = [r[0] for r in labelled.select("month").distinct().orderBy("month").collect()]  # of the calendar
    known = [(m, [float(x) for x in w], every.index(m)) for m, w, ok in zip(months, weights, fits, strict=True) if ok]
    table = rows.sparkSession.createDataFrame(known, "month string, _w array<double>, train_months long")
    z = sum((F.col(n) * F.get("_w", F.lit(k)) for k, n in enumerate(names)), F.get("_w", F.lit(len(names))))
    return labelled.where(finite).join(F.broadcast(table), "month").withColumn("p_raw", 1 / (1 + F.exp(-z))).drop("_w")  # a row a month


# ---- isotonic calibration


def pooled(blocks):
    """Pools falling neighbours of blocks [low, high, n, sum], in order, until means rise."""
    out: list[list[float]] = []
    for low, high, n, y in blocks:
        out.append([low, high, n, y])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, high2, n2, y2 = out.pop()
            out[-1] = [out[-1][0], high2, out[-1][2] + n2, out[-1][3] + y2]
    return out


def pooled_partition(batches):
    blocks: list[list[float]] = []
    for b in batches:
        blocks = pooled(blocks + [list(x) for x in zip(*(b.column(c).to_pylist() for c in ("low", "high", "n", "y")), strict=True)])
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blocks, strict=True), (pa.float64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["low", "high", "n", "y"])


def isotonic_blocks(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(low, high, n, y): blocks of scores of the least-squares rising fit, whose value is y / n.

    Equal scores are one point. Points are dealt to ranges and pooled there; the blocks that are left are pooled in fewer
    ranges, and last in one. Labels are 0 and 1, so rising blocks have different fractions, and N labels give of the order
    of N^(2/3) of them at most: a million for a billion."""
    points = rows.groupBy(F.col(score).alias("low")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("y")).select("low", F.col("low").alias("high"), "n", "y")
    schema = "low double, high double, n long, y long"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k in dict.fromkeys((parts, math.isqrt(parts), 1)):
        points = stored(points.repartitionByRange(k, "low").sortWithinPartitions("low").mapInArrow(pooled_partition, schema))
    return points


def quantile(points: DataFrame, shares: tuple[float, ...]) -> list[float]:
    """Quantiles, between neighbours in proportion, of points (score, n, up_to) with running counts; two rows a quantile."""
    total = points.agg(F.max("up_to")).first()[0]
    at = lambda k: points.where((F.col("up_to") > k) & (F.col("up_to") - F.col("n") <= k)).first()["score"]
    out = []
    for s in shares:
        place = (total - 1) * s
        a, b = at(math.floor(place)), at(math.ceil(place))
        out.append(a + (b - a) * (place - math.floor(place)))
    return out


def calibrated(rows: DataFrame, score: str, label: str, least: int = 500, positives: int = 50, top: int = 30) -> tuple[DataFrame, bool]:
    """(``rows`` with p_cal, whether it is the isotonic fit of its own scores). Unchanged scores where rows, positives or
    rows of either of the two top tenths are too few. Rows without score or label take no part in the fit."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    facts = known.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("y")).first()
    plain = rows.withColumn("p_cal", F.col(score)), False
    if facts["n"] < least or facts["y"] < positives or facts["y"] == facts["n"]:
        return plain
    points = stored(running(known.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n")), F.col("score"), {"up_to": "n"}))
    q80, q90 = quantile(points, (0.8, 0.9))
    tops = known.agg(F.count_if(F.col(score) >= q90).alias("a"), F.count_if((F.col(score) >= q80) & (F.col(score) < q90)).alias("b")).first()
    if min(tops) < top:
        return plain
    blocks = isotonic_blocks(known, score, label).select("low", "high", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("y") / F.col("n"))).alias("p_cal"))
    place = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col(c) * BINS))).cast("int")
    met = blocks.withColumn("_bin", F.explode(F.sequence(place("low"), place("high"))))
    if blocks.count() <= BROADCAST_ROWS:
        met = F.broadcast(met)
    binned = rows.withColumn("_bin", place(score))
    return binned.join(met, (binned["_bin"] == met["_bin"]) & F.col(score).between(F.col("low"), F.col("high")), "left").select(*rows.columns, "p_cal"), True


# ---- thresholds


def replicates(months: DataFrame, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, month): of each replicate the months that are drawn, as many draws as there are months, each from the
    digest of seed, replicate and draw; a month drawn twice is there once."""
    every = Window.orderBy("month")
    placed = months.select("month").distinct().withColumns({"place": F.row_number().over(every) - 1, "total": F.count("*").over(Window.partitionBy())})  # a row a month
    drawn = placed.select("place", "total", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("replicate"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "replicate", "place").cast("binary")), 1, 7), 16, 10).cast("long")
    drawn = drawn.select("replicate", (hashed % F.col("total")).alias("place")).distinct()
    return drawn.join(placed.select("place", "month"), "place").select("replicate", "month")


def judged_thresholds(rows: DataFrame, score: str = "p_cal", digits: int = 6, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(score, n, false_share, upper): for each rounded score what lies at or above it, and the 95 % quantile of the share
    of false ones over replicates of months. rows: month, label and score; without label or score they take no part.

    Rows come down to counts by month and rounded score, a million scores at most; running counts go by replicate."""
    counts = rows.where(F.col(score).isNotNull() & F.col("label").isNotNull()).groupBy("month", F.round(score, digits).alias("score")).agg(F.count("*").alias("n"), F.count_if(~F.col("label").cast("boolean")).alias("false"))
    counts = stored(counts)
    down = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = counts.groupBy("score").agg(F.sum("n").alias("n"), F.sum("false").alias("false"))
    whole = whole.select("score", F.sum("n").over(down()).alias("n"), F.sum("false").over(down()).alias("false"))
    drawn = counts.join(replicates(counts, rounds, seed), "month").groupBy("replicate", "score").agg(F.sum("n").alias("rn"), F.sum("false").alias("rf"))
    grid = counts.select("score").distinct().select("score", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("replicate"))
    sums = grid.join(drawn, ["replicate", "score"], "left").select("score", F.sum("rn").over(down("replicate")).alias("rn"), F.sum("rf").over(down("replicate")).alias("rf"))
    upper = sums.groupBy("score").agg(F.expr("percentile(CASE WHEN rn > 0 THEN rf / rn END, 0.95)").alias("upper"))
    if counts.select("month").distinct().count() < 2:
        upper = whole.select("score", (F.col("false") / F.col("n")).alias("upper"))
    return whole.join(upper, "score").select("score", "n", (F.col("false") / F.col("n")).alias("false_share"), "upper")


def fdr_threshold(judged: DataFrame, target: float, least: int = 30) -> dict:
    """The highest score with at least ``least`` rows whose bound is within the target."""
    best = judged.where((F.col("n") >= least) & (F.col("upper") <= target)).agg(F.max(F.struct("score", "n")).alias("x")).first()["x"]
    if best:
        return {"q_confirm": best["score"], "n_support": best["n"], "reason": None}
    return {"q_confirm": None, "n_support": 0, "reason": "no_threshold_meets_fdr" if not judged.isEmpty() else "no_crossfit_rows"}


#: Ladders, in the order in which they are tried: rungs (none: every score that occurs), least rows of the pool and of a rung.
CDF, SCORE, Z = 1, 2, 3
RUNGS = {CDF: (0.995, 0.99, 0.97, 0.95), SCORE: (), Z: (4.0, 3.5, 3.0, 2.75, 2.5)}
LEAST_POOL, LEAST_RUNG = {CDF: 20, SCORE: 30, Z: 0}, {CDF: 15, SCORE: 20, Z: 20}
#: How much better than jumps a rung is to be, or than all rows where it isn't.
LIFT = 0.05
MODES = {CDF: ("pred_cdf_beat_z_baseline", "pred_cdf_precision_lift"), SCORE: ("beat_z_baseline", "precision_lift"), Z: ("z_ladder_beat", "z_ladder_match")}
KEYS = {CDF: "cdf_confirm", SCORE: "q_confirm", Z: "z_confirm"}


def rungs(pool: DataFrame) -> tuple[DataFrame, dict]:
    """((kind, value, n, hits) of every rung, facts of the pool). pool: label, return_z, direction_up, ambiguous, pred_cdf,
    p_cal; a missing number stands on no rung."""
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    hit, jump = true("label"), F.coalesce(F.col("return_z") >= 2.5, F.lit(False)) & true("direction_up")
    facts = pool.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(jump).alias("jumps"), F.count_if(jump & hit).alias("jump_hits")).first().asDict()
    ladder = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, values in RUNGS.items() for v in values])
    stands = lambda x: F.when(x["kind"] == CDF, F.col("pred_cdf") >= x["value"]).otherwise((F.col("return_z") >= x["value"]) & true("direction_up") & ~true("ambiguous"))
    fixed = pool.select(hit.alias("hit"), F.inline(F.filter(ladder, stands))).groupBy("kind", "value").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    points = pool.where("p_cal IS NOT NULL").groupBy(F.col("p_cal").alias("value")).agg(F.count("*").alias("one"), F.count_if(hit).alias("good"))
    scores = running(points, -F.col("value"), {"n": "one", "hits": "good"}).select(F.lit(SCORE).alias("kind"), "value", "n", "hits")
    return fixed.unionByName(scores), facts


def ladder(pool: DataFrame) -> tuple[DataFrame, dict]:
    """((kind, value, n, precision, beats, place) of the rungs that will do, facts of the pool), place 1 for the chosen one.

    A rung will do if it has support and a precision no worse than that of jumps (of all rows, if jumps are too few) and,
    but for z, better than that of all rows by ``LIFT``; it beats the jumps if it is better than they by ``LIFT``. The
    first ladder with such a rung counts: there, what beats the jumps goes first, then the precision, then the lower value."""
    table, facts = rungs(pool)
    base = facts["hits"] / facts["n"] if facts["n"] else 0.0
    jumps = facts["jump_hits"] / facts["jumps"] if facts["jumps"] >= 10 else base
    by_kind = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("kind"))
    floors = {CDF: max(base + LIFT, jumps), SCORE: max(base + LIFT, jumps), Z: jumps}
    judged = table.withColumn("precision", F.col("hits") / F.col("n")).withColumn("beats", F.col("precision") >= jumps + LIFT)
    judged = judged.where((F.col("n") >= by_kind(LEAST_RUNG)) & (F.lit(facts["n"]) >= by_kind(LEAST_POOL)) & (F.col("beats") | (F.col("precision") >= by_kind(floors))))
    # ranked among the scores of one pool
    order = Window.orderBy("kind", F.desc("beats"), F.desc("precision"), "value")
    return judged.select("kind", "value", "n", "precision", "beats").withColumn("place", F.row_number().over(order)), {"base_rate": base, "z_baseline_precision": jumps}


def fallback_threshold(pool: DataFrame, thr: dict) -> dict:
    """Where no score meets the target: the chosen rung of the ladders."""
    table, facts = ladder(pool)
    none = facts | {"q_confirm": None, "cdf_confirm": None, "z_confirm": None}
    best = table.where("place = 1").first()
    if best is None:
        return {**thr, **none, "mode": "none"}
    return {**none, KEYS[best["kind"]]: best["value"], "mode": MODES[best["kind"]][not best["beats"]], "n_support": best["n"], "precision_at_q": best["precision"], "reason": None}


# ---- the last checks


def resampled_lift(known: DataFrame, sums: list[Column], rounds: int = 200, seed: int = 42) -> float | None:
    """The 2.5 % quantile over replicates of months of the precision of confirmed signals above that of jumps. sums: named
    counts c, ch, z, zh, zc, zch, cands (confirmed and hits, jumps and hits, those among candidates, candidates)."""
    months = known.groupBy("month").agg(*sums)
    each = months.join(replicates(months, rounds, seed), "month").groupBy("replicate").agg(*[F.sum(x).alias(x) for x in ("c", "ch", "z", "zh", "zc", "zch", "cands")])
    among = F.col("cands") >= 20
    each = each.withColumns({"a": F.when(among, F.col("zc")).otherwise(F.col("z")), "b": F.when(among, F.col("zch")).otherwise(F.col("zh"))}).where("c >= 5 AND a >= 5")
    return each.agg(F.expr("percentile(ch / c - b / a, 0.025)")).first()[0]


def go_no_go(rows: DataFrame, limit: float = 4.0, rounds: int = 200) -> dict:
    """Checks of signals with labels: switch rate, precision against jumps, calibration, false alarms and support. rows: code,
    date, month, label, signal_level, is_candidate, quantile_switch, return_z, direction_up, p_cal."""
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    confirmed, jump, hit, cand = F.col("signal_level") == "CONFIRM", F.coalesce(F.col("return_z") >= 2.5, F.lit(False)) & flag("direction_up"), flag("label"), flag("is_candidate")
    known = rows.where("label IS NOT NULL")
    count = lambda c, name: F.count_if(c).alias(name)
    sums = [count(confirmed, "c"), count(confirmed & hit, "ch"), count(jump, "z"), count(jump & hit, "zh"), count(jump & cand, "zc"), count(jump & cand & hit, "zch"), count(cand, "cands")]
    year = F.year(F.when(confirmed, F.col("date")))
    rated = cand & F.col("p_cal").isNotNull()
    one = known.agg(*sums, (F.max(year) - F.min(year) + 1).alias("years"), count(rated, "rated"), F.avg(F.when(rated, F.pow(F.col("p_cal") - hit.cast("int"), 2))).alias("brier")).first()
    every = rows.agg(F.avg(flag("quantile_switch").cast("int")).alias("rate"), F.countDistinct("code").alias("codes"), count(F.col("signal_level") == "OBSERVE", "observe")).first()
    bins = known.where(rated).groupBy(F.least(F.floor(F.col("p_cal") * 5), F.lit(4)).alias("bin")).agg((F.count("*") * F.abs(F.avg(hit.cast("int")) - F.avg("p_cal"))).alias("off"))
    off = bins.agg(F.sum("off")).first()[0]
    share = lambda a, b: a / b if b else math.nan
    enough, none = one["c"] >= 10, one["c"] == 0
    jumps, jump_hits = (one["zc"], one["zch"]) if one["cands"] >= 50 else (one["z"], one["zh"])
    precision, precision_z, ece = share(one["ch"], one["c"]) if enough else math.nan, share(jump_hits, jumps), share(off, one["rated"])
    low = resampled_lift(known, sums, rounds) if enough and jumps >= 10 else None
    low, lift = math.nan if low is None else low, precision - precision_z
    false_rate = 0.0 if none else (one["c"] - one["ch"]) / max(one["years"] or 1, 1) / max(every["codes"], 1)
    above = lift >= 0.05 and (low > 0 or one["c"] >= 15)
    checks = {
        "switch_coverage": every["rate"] is not None and 0.08 <= every["rate"] <= 0.35, "precision": bool(none or above or (precision >= precision_z and precision >= 0.30 and one["c"] >= 20)),
        "calibration": bool(one["rated"] >= 50 and one["brier"] <= 0.25 and ece <= 0.15), "false_alarms": none or false_rate <= limit, "threshold": none or enough,
    }
    return {
        "pass": all(checks.values()), "checks": checks, "switch_rate": every["rate"], "precision": precision, "precision_z": precision_z, "lift": lift, "lift_low": low, "n_confirm": one["c"], "n_observe": every["observe"], "brier": one["brier"],
        "ece": ece, "n_rated": one["rated"], "false_per_code_year": false_rate, "suppressed": none,
    }
