"""Choice of a pool of codes from clusters of a panel, and the review of what it missed.

Scores, quotas and ranks are windows and aggregates; what depends on the order of choices goes in rounds over the table of
pairs that are too alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import stored
from .graph import farthest_first, first_fit
from .pairs import both_ways

TARGET, CLUSTER_DAYS, SELECTION_DAYS, SKIP = 200, 120, 180, 21
SAME, OTHER, LADDER, BASE = 0.60, 0.70, (0.70, 0.75, 0.80), 0.65
WEIGHTS = {"equal": lambda r: F.lit(1.0), "harmonic": lambda r: 1 / r, "exp": lambda r: F.pow(F.lit(BASE), r - 1)}


def rank_share(x: Column, by: list[str]) -> Column:
    """Rank over count, ties at their average."""
    # equal up to rounding is equal
    key = F.round(x, 12)
    within = Window.partitionBy(*by)
    return (F.rank().over(within.orderBy(key)) + (F.count("*").over(Window.partitionBy(*by, key)) - 1) / F.lit(2.0)) / F.count("*").over(within)


def measures(returns: DataFrame) -> DataFrame:
    """(code, mean, sharpe, momentum, days) from (code, date, ret): the last ``SKIP`` days of the calendar are no momentum."""
    days = returns.select("date").distinct()
    order = days.withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))))  # a row a day
    n = days.count()
    skip = min(SKIP, max(0, n - 1))
    rows = returns.join(F.broadcast(order), "date").where("ret IS NOT NULL")
    sharpe = F.avg("ret") / F.nullif(F.stddev_pop("ret"), F.lit(0.0)) * F.sqrt(F.lit(252.0))
    return rows.groupBy("code").agg(F.avg("ret").alias("mean"), F.coalesce(sharpe, F.lit(0.0)).alias("sharpe"), F.coalesce(F.product(F.when(F.col("back") > skip, 1 + F.col("ret"))) - 1, F.lit(0.0)).alias("momentum"), F.count("*").alias("days"))


def scored(measured: DataFrame, by: tuple[str, ...] = (), mode: str = "sharpe_mom") -> DataFrame:
    """``measured`` with score, ranked within ``by``; in mode ``legacy_mean`` the rank of the mean return alone."""
    keys = list(by) or [F.lit(0)]
    score = rank_share(F.col("mean"), keys) if mode == "legacy_mean" else 0.5 * rank_share(F.col("sharpe"), keys) + 0.5 * rank_share(F.col("momentum"), keys)
    return measured.withColumn("score", score)


def diagnostics(universe: DataFrame, returns: DataFrame, overlaps: DataFrame, closes: DataFrame) -> DataFrame:
    """A row for each code of ``universe``: days of history and of recent returns, whether it may be clustered and selected,
    its overlaps (code, overlap_min_days, overlap_median_days, overlap_max_days; 0 where it has none), and why it can't."""
    history = closes.where("close IS NOT NULL").groupBy("code").agg(F.count("*").alias("available_history_days"))
    recent = returns.where("ret IS NOT NULL").groupBy("code").agg(F.count("*").alias("recent_valid_days"))
    rows = universe.select("code").distinct().join(history, "code", "left").join(recent, "code", "left").join(overlaps, "code", "left")
    rows = rows.select("code", *[F.coalesce(c, F.lit(0)).cast("double" if c == "overlap_median_days" else "long").alias(c) for c in ("available_history_days", "recent_valid_days", "overlap_min_days", "overlap_median_days", "overlap_max_days")])
    days = F.col("recent_valid_days")
    reason = F.when(F.col("available_history_days") == 0, "missing_from_data").when(days < CLUSTER_DAYS, "insufficient_history_for_clustering")
    return rows.withColumn("eligible_for_cluster", days >= CLUSTER_DAYS).withColumn("eligible_for_selection", days >= SELECTION_DAYS).withColumn("reason", reason)


def overlap_summary(pairs: DataFrame) -> DataFrame:
    """Least, median and most common days of each code with its peers that it has any with."""
    return both_ways(pairs).where("overlap > 0").groupBy("code").agg(F.min("overlap").alias("overlap_min_days"), F.median("overlap").alias("overlap_median_days"), F.max("overlap").alias("overlap_max_days"))


def cluster_stats(clusters: DataFrame, pairs: DataFrame, returns: DataFrame, volumes: DataFrame) -> DataFrame:
    """A row a cluster: n, mean_corr of its pairs (1 for a single code), mean deviation, mean return, mean volume, least and
    median days, in no order."""
    a, b = (clusters.select(F.col("code").alias(c), F.col("cluster").alias(f"cluster_{c}")) for c in ("code_a", "code_b"))
    corr = pairs.join(a, "code_a").join(b, "code_b").where("cluster_code_a = cluster_code_b").groupBy(F.col("cluster_code_a").alias("cluster")).agg(F.avg("corr").alias("mean_corr"))
    one = returns.groupBy("code").agg(F.stddev_samp("ret").alias("s"), F.avg("ret").alias("m"), F.count("ret").alias("d")).join(volumes.groupBy("code").agg(F.avg("volume").alias("v")), "code", "left")
    rows = clusters.join(one, "code", "left").groupBy("cluster").agg(
        F.count("*").alias("n"), F.avg("s").alias("mean_volatility"), F.avg("m").alias("mean_return"), F.avg("v").alias("avg_volume"), F.min(F.coalesce("d", F.lit(0))).alias("min_history_days"), F.median(F.coalesce("d", F.lit(0))).alias("median_history_days")
    )
    return rows.join(corr, "cluster", "left").withColumn("mean_corr", F.coalesce("mean_corr", F.lit(1.0)))


def quotas(sizes: DataFrame, target: int) -> DataFrame:
    """``sizes`` (cluster, n, top) with raw_quota and cap: the rounded-up share of the target, topped up to some candidates
    more in order of the remainder, size, top score and cluster. One row a cluster."""
    every = Window.partitionBy()
    order = Window.orderBy(F.desc("remainder"), F.desc("n"), F.desc(F.round("top", 9)), "cluster")
    rows = sizes.withColumn("total", F.sum("n").over(every)).withColumn("raw_quota", F.col("n") / F.col("total") * target)
    rows = rows.withColumn("cap", F.greatest(F.lit(1), F.least(F.ceil("raw_quota"), F.col("n")))).withColumn("remainder", F.round(F.col("raw_quota") - F.floor("raw_quota"), 9))
    wanted = target + F.least(F.lit(max(5, -(-target * 15 // 100))), F.greatest(F.lit(0), F.col("total") - target))
    rows = rows.withColumn("need", F.greatest(F.lit(0), wanted - F.sum("cap").over(every)))
    before = F.coalesce(F.sum(F.col("n") - F.col("cap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("cap", F.col("cap") + F.least(F.col("n") - F.col("cap"), F.greatest(F.lit(0), F.col("need") - before))).select("cluster", "n", "raw_quota", F.col("cap").cast("int").alias("cap"))


def candidates(clusters: DataFrame, returns: DataFrame, target: int = TARGET, scheme: str = "equal") -> DataFrame:
    """(code, cluster, score, days, nth, rank, place): the members of each cluster that may stand for it in order of their
    score, ``rank`` up to the cluster's cap (else null), and the place in which candidates are tried.

    Members with ``SELECTION_DAYS`` days or more may stand for a cluster, or all of them if it has none such."""
    measured = measures(returns)
    whole = Window.partitionBy("cluster")
    members = clusters.select("code", "cluster").join(scored(measured), "code").withColumn("long", F.col("days") >= SELECTION_DAYS).withColumn("any_long", F.max("long").over(whole)).where("long OR NOT any_long")
    inside = scored(members.drop("score"), ("cluster",)).groupBy("cluster").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    ranked = members.withColumn("nth", F.row_number().over(whole.orderBy(F.desc(F.round("score", 12)), "code")))
    rows = ranked.join(quotas(inside, target), "cluster").withColumn("rank", F.when(F.col("nth") <= F.col("cap"), F.col("nth")))
    weight = WEIGHTS[scheme](F.col("rank"))
    # each cluster's first, then all others by priority
    first = F.when(F.col("rank") == 1, F.col("score")).otherwise(F.col("score") * weight)
    order = Window.orderBy(F.col("rank").isNull(), F.col("rank") > 1, F.desc(F.round(first, 12)), F.desc(F.round("score", 12)), F.desc("raw_quota"), F.desc(weight), "cluster", "rank", "code")
    return rows.withColumn("place", F.when(F.col("rank").isNotNull(), F.row_number().over(order))).select("code", "cluster", "score", "days", "nth", "rank", "place")


def select(ranked: DataFrame, stats: DataFrame, pairs: DataFrame, target: int = TARGET, scheme: str = "equal") -> DataFrame:
    """(code, cluster, place, reason): the candidates in order of ``place`` up to the target that aren't too like one kept
    already, and for a cluster that is left without any, its first member that isn't."""
    lead = Window.orderBy(F.desc("mean_corr"), F.desc("n"), "cluster")  # a row a cluster
    rows = ranked.join(stats.select("cluster", "mean_corr", "n").withColumn("turn", F.row_number().over(lead)), "cluster")
    tried = F.col("place") <= target
    # then what is left of the clusters, in their turns
    rows = rows.withColumn("spare", ~F.coalesce(tried, F.lit(False)))
    walk = Window.orderBy("spare", F.when(~F.col("spare"), F.col("place")), "turn", "nth")
    rows = stored(rows.withColumn("walk", F.row_number().over(walk)))
    limit = F.when(F.col("cluster_a") == F.col("cluster_b"), SAME).otherwise(OTHER)
    ends = [rows.select(F.col("code").alias(f"code_{x}"), F.col("cluster").alias(f"cluster_{x}")) for x in "ab"]
    alike = pairs.join(ends[0], "code_a").join(ends[1], "code_b").where(F.abs("corr") > limit)
    kept = first_fit(rows.select(F.col("code").alias("id"), F.col("walk").alias("place"), "cluster", "spare"), alike.select(F.col("code_a").alias("a"), F.col("code_b").alias("b")))
    how = F.when(F.col("spare"), F.concat(F.col("nth"), F.lit("_coverage_rescue"))).otherwise(F.concat(F.col("rank"), F.when(F.col("rank") == 1, "_coverage").otherwise("")))
    reason = F.concat(F.lit(f"multi_rep_{scheme}_cluster_"), F.col("cluster"), F.lit("_rank_"), how, F.when(F.col("days") < SELECTION_DAYS, "_short_history").otherwise(""))
    named = rows.join(kept.select(F.col("id").alias("code")), "code").withColumn("reason", reason)
    # at most the target and a code a cluster
    return named.select("code", "cluster", F.row_number().over(Window.orderBy("walk")).alias("place"), "reason")


def representatives(ranked: DataFrame, per_cluster: int = 1) -> DataFrame:
    """The best so many members of each cluster and the reason for it."""
    size = Window.partitionBy("cluster")
    short = F.when(F.col("days") < SELECTION_DAYS, "_short_history").otherwise("")
    alone = F.count("*").over(size) == 1
    rows = ranked.withColumn("reason", F.concat(F.when(alone, "only_member_cluster_").otherwise("return_top_cluster_"), F.col("cluster").cast("string"), short))
    return rows.where(F.col("nth") <= per_cluster).select("code", "cluster", "score", "reason")


def trimmed(codes: DataFrame, pairs: DataFrame, target: int, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """(code, nth) of at most ``target`` of the codes (code, mean): always the one least like those taken, then of the
    highest mean, then the first. A limit is raised when none is left below it; since the least alike is taken anyway, only
    the last of the limits decides who is left out."""
    weights = pairs.select(F.col("code_a").alias("a"), F.col("code_b").alias("b"), F.abs("corr").alias("w"))
    return farthest_first(codes.select(F.col("code").alias("id"), "mean"), weights, target, max(ladder)).withColumnRenamed("id", "code")


def trailing_returns(closes: DataFrame, windows: list[int], end: Column | None = None) -> DataFrame:
    """(code, ret_<w>, rank_<w>, ...) of closes (code, date, close): the last close up to ``end`` over the first one of the
    last w + 1 days of the calendar, and its rank over count among all codes that have one, ties at their average."""
    rows = closes.where("close IS NOT NULL") if end is None else closes.where("close IS NOT NULL").where(F.col("date") <= end)
    order = rows.select("date").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)  # a row a day
    dated = rows.join(F.broadcast(order), "date")
    first = lambda w: F.min_by(F.when(F.col("back") <= w, F.col("close")), F.when(F.col("back") <= w, F.col("date")))
    out = dated.groupBy("code").agg(*[(F.max_by("close", "date") / F.nullif(first(w), F.lit(0.0)) - 1).alias(f"ret_{w}") for w in windows])
    ranks = [F.when(F.col(f"ret_{w}").isNotNull(), rank_share(F.col(f"ret_{w}"), [F.col(f"ret_{w}").isNull()])).alias(f"rank_{w}") for w in windows]
    return out.select("*", *ranks)


def volume_ranks(clusters: DataFrame, volumes: DataFrame) -> DataFrame:
    """(code, avg_volume, volume_rank): the rank of the mean volume in the cluster, ties at the best."""
    rows = clusters.join(volumes.groupBy("code").agg(F.avg("volume").alias("avg_volume")), "code")
    return rows.select("code", "avg_volume", F.rank().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("avg_volume", 9)))).alias("volume_rank"))


def missed_clusters(mapped: DataFrame, metrics: DataFrame, window: int, least: int = 2, shown: int = 6) -> DataFrame:
    """Clusters of ``mapped`` (code, cluster, selected, reason) without a selected code and with enough members: n, the best
    member by return, why none was selected, and the first members by name. metrics: of ``trailing_returns``."""
    rows = mapped.join(metrics.select("code", F.col(f"ret_{window}").alias("ret")), "code", "left")
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("code"))
    best = F.max_by("code", F.struct(F.col("ret").isNotNull(), F.round("ret", 12)))
    # members beyond the first few are counted, not listed
    listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.col("code")))), "|")
    found = rows.withColumn("nth", nth).groupBy("cluster").agg(F.count("*").alias("n"), best.alias("best_code"), F.max("ret").alias("best_ret"), F.max(F.col("selected").cast("int")).alias("any"), listed.alias("members"), F.flatten(F.collect_set(tags(F.col("reason")))).alias("tags"))
    return found.where((F.col("any") == 0) & (F.col("n") >= least)).select("cluster", "n", "best_code", "best_ret", "members", reason_kind(F.col("tags")).alias("reason_kind"))


def rep_lag(mapped: DataFrame, metrics: DataFrame, ranks: DataFrame, window: int, least: float = 0.01) -> DataFrame:
    """Selected codes behind the best of their cluster: rank by return, regret, and whether their volume isn't the largest.
    A code without return is kept with null regret."""
    rows = mapped.join(metrics.select("code", F.col(f"ret_{window}").alias("ret")), "code", "left").join(ranks.select("code", "volume_rank"), "code", "left")
    whole = Window.partitionBy("cluster")
    rows = rows.withColumn("regret", F.max("ret").over(whole) - F.col("ret")).withColumn("rnk", F.when(F.col("ret").isNotNull(), F.rank().over(whole.orderBy(F.desc_nulls_last(F.round("ret", 12))))))
    behind = F.col("regret").isNull() | ((F.col("rnk") > 1) & (F.col("regret") >= least))
    return rows.where(F.col("selected") & behind).select("code", "cluster", "rnk", "regret", (F.coalesce("volume_rank", F.lit(1)) > 1).alias("low_volume"))


def reason_kind(tags: Column) -> Column:
    """Why a cluster has no selected code, from the tags of its members."""
    has = lambda text: F.exists(tags, lambda t: t.contains(text))
    return F.when(has("insufficient_history"), "insufficient_history").when(has("missing_from_data"), "missing_from_data").when(F.size(tags) > 0, "mixed_diagnostics").otherwise("target_count_not_selected")


def tags(reason: Column) -> Column:
    """The parts of a reason between bars, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(reason, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def related(missed: DataFrame, clusters: DataFrame, selected: DataFrame, far: DataFrame, returns: DataFrame, top: int = 3) -> DataFrame:
    """(cluster, related, distance, nth) for each missed cluster: the clusters with a selected code that are nearest by the
    least cophenetic distance of their members, then by the best return of their selected codes, then by number.
    returns: (code, ret)."""
    with_selected = clusters.join(selected.select("code").distinct(), "code", "left_semi")
    best = with_selected.join(returns, "code", "left").groupBy(F.col("cluster").alias("related")).agg(F.max("ret").alias("best"))
    ways = far.select("code_a", "code_b", "distance").union(far.select("code_b", "code_a", "distance")).toDF("code", "peer", "distance")
    pairs = ways.join(clusters.join(missed.select("cluster").distinct(), "cluster", "left_semi"), "code").join(clusters.select(F.col("code").alias("peer"), F.col("cluster").alias("related")), "peer").where("cluster <> related")
    near = pairs.join(best, "related").groupBy("cluster", "related").agg(F.min("distance").alias("distance"), F.first("best").alias("best"))
    order = Window.partitionBy("cluster").orderBy(F.round("distance", 12), F.desc_nulls_last("best"), "related")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top).select("cluster", "related", "distance", "nth")


def mapping(universe: DataFrame, clusters: DataFrame, selected: DataFrame, reasons: DataFrame, stats: DataFrame) -> DataFrame:
    """A row for each code of the universe (code, name, ...): cluster, n, selected and reason, null cluster where it has none."""
    out = universe.join(clusters.select("code", "cluster"), "code", "left").join(stats.select("cluster", "n"), "cluster", "left")
    chosen = selected.select("code", F.lit(True).alias("selected"), F.col("reason").alias("own"))
    return out.join(chosen, "code", "left").join(reasons.select("code", "reason"), "code", "left").withColumn("selected", F.coalesce("selected", F.lit(False))).withColumn("reason", F.coalesce("own", "reason", F.lit(""))).drop("own")
