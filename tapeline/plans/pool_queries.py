"""Queries of the pool's choice and its review on the panel: with groups by name, which have SQL of another engine, and with
the clusters that Ward's tree gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import other_sql
from ..operators import clusters as ward
from ..operators import pool
from ..operators.pairs import LEAST_DAYS, pair_table, subset
from ..sources.adapters import PANEL
from .panel_sql import CLUSTER, RECENT, RECENT_PAIRS, SCORES
from .views import view_query

#: Codes of the panel are few, so are those chosen.
TARGET = 10


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_query(f"WITH {PANEL},{RECENT} SELECT code, date, ret, volume FROM recent")(spark, sf_dir)


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_query(f"WITH {PANEL},{CLUSTER} SELECT code, cluster FROM cl")(spark, sf_dir)


def chosen(spark: SparkSession, sf_dir: str, least: int = LEAST_DAYS, together: float = 0.55) -> tuple[DataFrame, ...]:
    """(returns, pairs, clusters, statistics, candidates, selection) on Ward's clusters, split where correlations are below
    ``together``."""
    from ..sources.checkpoints import stored

    rows = stored(recent(spark, sf_dir))
    pairs = stored(pair_table(rows, least))
    clusters = stored(ward.ward_clusters(pairs, least_corr=together).select("code", F.col("split").alias("cluster")))
    stats = pool.cluster_stats(clusters, pairs, rows, rows)
    ranked = pool.candidates(clusters, rows, TARGET)
    return rows, pairs, clusters, stats, ranked, pool.select(ranked, stats, pairs, TARGET)


def a04_pair_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recent(spark, sf_dir)
    return subset(pair_table(rows), rows.select("code").where("code LIKE '%1%'")).where("overlap > 0").select("code_a", "code_b", "overlap", F.round("corr", 6).alias("corr"))


def a07_cluster_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recent(spark, sf_dir)
    stats = pool.cluster_stats(grouped(spark, sf_dir), pair_table(rows), rows, rows)
    return stats.select("cluster", "n", *[F.round(c, 6).alias(c) for c in ("mean_corr", "mean_volatility", "mean_return", "avg_volume")], "min_history_days", F.col("median_history_days").cast("double").alias("median_history_days"))


def f12_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth day is missing for some codes, and two codes of the universe have no data."""
    rows = recent(spark, sf_dir).where("NOT (code LIKE '%2' AND day(date) % 3 > 0)")
    universe = rows.select("code").union(spark.createDataFrame([("Brand#98",), ("Brand#99",)], "code string"))
    found = pool.diagnostics(universe, rows, pool.overlap_summary(pair_table(rows)), rows.withColumn("close", F.col("volume")))
    return found


def j03_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe with clusters, sizes, the best code of each cluster as selected, and reasons."""
    rows, cl = recent(spark, sf_dir), grouped(spark, sf_dir).where("cluster <> 3")
    stats = cl.groupBy("cluster").agg(F.count("*").alias("n"))
    best = pool.representatives(pool.candidates(cl, rows, TARGET))
    universe = rows.select("code").distinct().withColumn("name", F.lower("code"))
    reasons = universe.select("code", F.lit("insufficient_history_for_clustering").alias("reason")).where("code LIKE '%3'")
    return pool.mapping(universe, cl, best, reasons, stats).select("code", "name", "cluster", "n", "selected", "reason")


def p16_cluster_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = pool.candidates(grouped(spark, sf_dir), recent(spark, sf_dir), TARGET)
    return pool.representatives(ranked, 2).select("code", "cluster", F.round("score", 6).alias("score"), "reason")


def p14_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = pool.candidates(grouped(spark, sf_dir), recent(spark, sf_dir), TARGET, "exp")
    return ranked.where("rank IS NOT NULL").select("code", "cluster", F.round("score", 6).alias("score"), "rank", "place")


def j12_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without a code of small number, and their nearest others by 1 - corr."""
    rows, cl = recent(spark, sf_dir), grouped(spark, sf_dir)
    far = pair_table(rows).select("code_a", "code_b", F.round(1 - F.col("corr"), 9).alias("distance"))
    last = rows.groupBy("code").agg(F.round(F.max_by("ret", "date"), 9).alias("ret"))
    missed = cl.where("cluster >= 2").select("cluster").distinct()
    found = pool.related(missed, cl, cl.where("cluster < 2 OR code = 'Brand#3'").where("code <> 'Brand#4'"), far, last)
    return found.select("cluster", "related", F.round("distance", 6).alias("distance"), "nth")


def closes(rows: DataFrame) -> DataFrame:
    """Prices that start from 1, of the recent returns."""
    before = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("code", "date", F.exp(F.sum(F.log(1 + F.col("ret"))).over(before)).alias("close"))


def j02_review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping with trailing returns, their ranks and volume ranks."""
    rows, cl = recent(spark, sf_dir), grouped(spark, sf_dir)
    metrics = pool.trailing_returns(closes(rows), [5, 20, 60])
    out = cl.join(metrics, "code", "left").join(pool.volume_ranks(cl, rows), "code", "left")
    return out.select("code", "cluster", *[F.round(f"{k}_{w}", 6).alias(f"{k}_{w}") for w in (5, 20, 60) for k in ("ret", "rank")], F.round("avg_volume", 4).alias("avg_volume"), "volume_rank")


def reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, cl = recent(spark, sf_dir), grouped(spark, sf_dir)
    chosen_ = (F.col("cluster") < 3) & (F.row_number().over(Window.partitionBy("cluster").orderBy("code")) == 1)
    reason = F.when(F.col("code").like("%7"), "x | insufficient_history_for_clustering").otherwise("")
    return cl.withColumn("selected", chosen_).withColumn("reason", reason), pool.trailing_returns(closes(rows), [20]), pool.volume_ranks(cl, rows)


def a11_missed_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped, metrics, _ = reviewed(spark, sf_dir)
    return pool.missed_clusters(mapped, metrics, 20).withColumn("best_ret", F.round("best_ret", 6))


def a12_rep_lag_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.rep_lag(*reviewed(spark, sf_dir), 20).withColumn("regret", F.round("regret", 6))


def m06_cophenetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ward.cophenetic_pairs(pair_table(recent(spark, sf_dir), 1, 0.0)).select("code_a", "code_b", F.round("distance", 6).alias("distance"))


def p14_pool_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool on Ward's clusters: scores, quotas, greedy choice and rescue."""
    return chosen(spark, sf_dir)[-1]


#: Common days from which on a correlation counts here, since the panel's codes have few.
DAYS = 60


def p14_greedy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice without near-clones on groups by name, and the rescue of groups that are left without a code."""
    rows, cl = recent(spark, sf_dir), grouped(spark, sf_dir)
    pairs = pair_table(rows, DAYS)
    return pool.select(pool.candidates(cl, rows, TARGET, "exp"), pool.cluster_stats(cl, pairs, rows, rows), pairs, TARGET, "exp")


def p15_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes that are least alike, one after the other."""
    rows = recent(spark, sf_dir)
    return pool.trimmed(rows.groupBy("code").agg(F.round(F.avg("ret"), 9).alias("mean")), pair_table(rows, DAYS).where("overlap > 0").withColumn("corr", F.round("corr", 9)), TARGET)


#: Pairs of the panel that stay together: correlations within a group by name are some 0.7 to 0.9.
TOGETHER = 0.81


def j15_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by name fall apart into components of like codes."""
    return ward.split_by_corr(grouped(spark, sf_dir), pair_table(recent(spark, sf_dir), DAYS), TOGETHER)


def m07_related_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that the pool missed, with the nearest ones it has. Ward's clusters are split so finely that parts of one are
    too alike for two of them to be chosen."""
    rows, pairs, clusters, _, _, selection = chosen(spark, sf_dir, DAYS, TOGETHER)
    missed = clusters.join(selection.select("cluster").distinct(), "cluster", "left_anti").select("cluster").distinct()
    last = rows.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where("nth <= 20").groupBy("code").agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    return pool.related(missed, clusters, selection, ward.cophenetic_pairs(pairs), last).select("cluster", "related", F.round("distance", 6).alias("distance"), "nth")


QUERIES = {f.__name__: f for f in (a04_pair_subset, a07_cluster_history, f12_diagnostics, j03_mapping, p16_cluster_picks, p14_candidates, j12_related, j02_review_metrics, a11_missed_review, a12_rep_lag_review, m06_cophenetic, p14_pool_selection, m07_related_clusters, p14_greedy_choice, p15_trim, j15_components)}

_START = f"WITH {PANEL},{RECENT}"
_SCORED = f"{_START},{SCORES},{CLUSTER},rr AS (SELECT c.code, c.cluster, s.score, (SELECT count(*) FROM recent r WHERE r.code = c.code) AS days FROM cl c JOIN scores s ON s.code = c.code)"
_RANKED = "rk2 AS (SELECT *, days >= 180 AS ok, max(days >= 180) OVER (PARTITION BY cluster) AS any_ok FROM rr), rk3 AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 12) DESC, code) AS nth FROM rk2 WHERE ok OR NOT any_ok)"
_PAIRS = RECENT_PAIRS
_CLOSES = "px AS (SELECT r.code, r.date, d.back - 1 AS back, exp(sum(ln(1 + r.ret)) OVER (PARTITION BY r.code ORDER BY r.date ROWS UNBOUNDED PRECEDING)) AS close FROM recent r JOIN days d ON d.date = r.date)"
_TRAIL = lambda w: f"arg_max(close, date) / arg_min(close, date) FILTER (WHERE back <= {w}) - 1"
_RANK = lambda w: f"CASE WHEN ret_{w} IS NOT NULL THEN (rank() OVER (PARTITION BY ret_{w} IS NULL ORDER BY round(ret_{w}, 12)) + (count(*) OVER (PARTITION BY round(ret_{w}, 12)) - 1) / 2.0) / count(ret_{w}) OVER () END"
_METRICS = f"{_CLOSES}, mt AS (SELECT code, {_TRAIL(5)} AS ret_5, {_TRAIL(20)} AS ret_20, {_TRAIL(60)} AS ret_60 FROM px GROUP BY code), vr AS (SELECT cl.code, cl.cluster, avg(volume) AS avg_volume, rank() OVER (PARTITION BY cl.cluster ORDER BY round(avg(volume), 9) DESC) AS volume_rank FROM cl JOIN recent r ON r.code = cl.code GROUP BY cl.code, cl.cluster)"
_MAPPED = "mp AS (SELECT cl.code, cl.cluster, cl.cluster < 3 AND row_number() OVER (PARTITION BY cl.cluster ORDER BY cl.code) = 1 AS selected, ret_20, volume_rank FROM cl LEFT JOIN mt ON mt.code = cl.code LEFT JOIN vr ON vr.code = cl.code)"
ORACLE_SQL = {name: other_sql(text) for name, text in {
    "j02_review_metrics": f"{_START},{CLUSTER},{_METRICS} SELECT cl.code, cl.cluster, {', '.join(f'round(ret_{w}, 6) AS ret_{w}, round({_RANK(w)}, 6) AS rank_{w}' for w in (5, 20, 60))}, round(avg_volume, 4) AS avg_volume, CAST(volume_rank AS INTEGER) AS volume_rank FROM cl LEFT JOIN mt ON mt.code = cl.code LEFT JOIN vr ON vr.code = cl.code",
    "a11_missed_review": f"""{_START},{CLUSTER},{_METRICS},{_MAPPED} SELECT cluster, count(*) AS n, arg_max(code, round(ret_20, 12)) AS best_code, round(max(ret_20), 6) AS best_ret, array_to_string(list_sort(list(code))[1:6], '|') AS members, CASE WHEN bool_or(code LIKE '%7') THEN 'insufficient_history' ELSE 'target_count_not_selected' END AS reason_kind
  FROM mp GROUP BY cluster HAVING NOT bool_or(selected) AND count(*) >= 2""",
    "a12_rep_lag_review": f"""{_START},{CLUSTER},{_METRICS},{_MAPPED}, w AS (SELECT *, max(ret_20) OVER (PARTITION BY cluster) - ret_20 AS regret, rank() OVER (PARTITION BY cluster ORDER BY round(ret_20, 12) DESC NULLS LAST) AS rnk FROM mp)
SELECT code, cluster, CAST(CASE WHEN ret_20 IS NOT NULL THEN rnk END AS INTEGER) AS rnk, round(regret, 6) AS regret, volume_rank > 1 AS low_volume FROM w WHERE selected AND (regret IS NULL OR (rnk > 1 AND regret >= 0.01))""",
    "a04_pair_subset": f"{_START},{_PAIRS} SELECT code_a, code_b, overlap, round(corr, 6) AS corr FROM corr WHERE code_a LIKE '%1%' AND code_b LIKE '%1%'",
    "a07_cluster_history": f"""{_START},{_PAIRS},{CLUSTER}, pc AS (SELECT a.cluster, avg(c.corr) AS m FROM corr c JOIN cl a ON a.code = c.code_a JOIN cl b ON b.code = c.code_b AND b.cluster = a.cluster GROUP BY a.cluster),
one AS (SELECT r.code, cl.cluster, stddev_samp(ret) AS s, avg(ret) AS m, avg(volume) AS v, count(*) AS n FROM recent r JOIN cl ON cl.code = r.code GROUP BY r.code, cl.cluster)
SELECT o.cluster, count(*) AS n, round(coalesce(any_value(pc.m), 1), 6) AS mean_corr, round(avg(s), 6) AS mean_volatility, round(avg(o.m), 6) AS mean_return, round(avg(v), 6) AS avg_volume, min(o.n) AS min_history_days, median(o.n) AS median_history_days FROM one o LEFT JOIN pc ON pc.cluster = o.cluster GROUP BY o.cluster""",
    "f12_diagnostics": f"""{_START}, part_ AS (SELECT * FROM recent WHERE NOT (code LIKE '%2' AND extract(day FROM date) % 3 > 0)), d AS (SELECT code, count(*) AS days FROM part_ GROUP BY code),
o AS (SELECT a.code, b.code AS peer, count(*) AS n FROM part_ a JOIN part_ b ON b.date = a.date AND b.code <> a.code GROUP BY a.code, b.code), s AS (SELECT code, min(n) AS lo, median(n) AS mid, max(n) AS hi FROM o GROUP BY code)
SELECT code, days AS available_history_days, days AS recent_valid_days, lo AS overlap_min_days, mid AS overlap_median_days, hi AS overlap_max_days, days >= 120 AS eligible_for_cluster, days >= 180 AS eligible_for_selection, CASE WHEN days < 120 THEN 'insufficient_history_for_clustering' END AS reason FROM d JOIN s USING (code)
UNION ALL SELECT c, 0, 0, 0, 0.0, 0, false, false, 'missing_from_data' FROM (VALUES ('Brand#98'), ('Brand#99')) t(c)""",
    "j03_mapping": f"""{_SCORED},{_RANKED}, n AS (SELECT cluster, count(*) AS n FROM cl WHERE cluster <> 3 GROUP BY cluster), bst AS (SELECT *, 'return_top_cluster_' || cluster || CASE WHEN days < 180 THEN '_short_history' ELSE '' END AS why FROM rk3 WHERE nth = 1 AND cluster <> 3)
SELECT cl.code, lower(cl.code) AS name, CASE WHEN cl.cluster <> 3 THEN cl.cluster END AS cluster, n.n, bst.code IS NOT NULL AS selected, coalesce(bst.why, CASE WHEN cl.code LIKE '%3' THEN 'insufficient_history_for_clustering' END, '') AS reason FROM cl LEFT JOIN n ON n.cluster = cl.cluster LEFT JOIN bst ON bst.code = cl.code""",
    "p16_cluster_picks": f"{_SCORED},{_RANKED} SELECT code, cluster, round(score, 6) AS score, 'return_top_cluster_' || cluster || CASE WHEN days < 180 THEN '_short_history' ELSE '' END AS reason FROM rk3 WHERE nth <= 2",
    "p14_candidates": f"""{_SCORED},{_RANKED}, raw AS (SELECT cluster, count(*) AS n, CAST(10 AS DOUBLE) * count(*) / sum(count(*)) OVER () AS q, sum(count(*)) OVER () AS total FROM rk3 GROUP BY cluster),
cap1 AS (SELECT *, greatest(1, least(CAST(ceil(q) AS INT), n)) AS cap, round(q - floor(q), 9) AS rem FROM raw),
inner_top AS (SELECT k.cluster, max(0.5 * rs2 + 0.5 * rm2) AS top FROM (SELECT r.cluster, r.code, (rank() OVER (PARTITION BY r.cluster ORDER BY round(sm.sharpe, 12)) + (count(*) OVER (PARTITION BY r.cluster, round(sm.sharpe, 12)) - 1) / 2.0) / count(*) OVER (PARTITION BY r.cluster) AS rs2,
  (rank() OVER (PARTITION BY r.cluster ORDER BY round(sm.mom, 12)) + (count(*) OVER (PARTITION BY r.cluster, round(sm.mom, 12)) - 1) / 2.0) / count(*) OVER (PARTITION BY r.cluster) AS rm2 FROM rk3 r JOIN sm ON sm.code = r.code) k GROUP BY k.cluster),
cap2 AS (SELECT c.*, greatest(0, 10 + least(5, greatest(0, total - 10)) - sum(cap) OVER ()) AS need, coalesce(sum(n - cap) OVER (ORDER BY rem DESC, n DESC, round(top, 9) DESC, c.cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cap1 c JOIN inner_top t ON t.cluster = c.cluster),
caps AS (SELECT cluster, q, cap + least(n - cap, greatest(0, need - before)) AS cap FROM cap2),
cand AS (SELECT r.*, q, power(0.65, nth - 1) AS w FROM rk3 r JOIN caps c ON c.cluster = r.cluster WHERE nth <= cap)
SELECT code, cluster, round(score, 6) AS score, CAST(nth AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY nth > 1, round(CASE WHEN nth = 1 THEN score ELSE score * w END, 12) DESC, round(score, 12) DESC, q DESC, w DESC, cluster, nth, code) AS INTEGER) AS place FROM cand""",
    "j12_related": f"""{_START},{_PAIRS},{CLUSTER}, sel AS (SELECT * FROM cl WHERE (cluster < 2 OR code = 'Brand#3') AND code <> 'Brand#4'), lastr AS (SELECT code, round(arg_max(ret, date), 9) AS ret FROM recent GROUP BY code),
best AS (SELECT sel.cluster AS related, max(ret) AS best FROM sel LEFT JOIN lastr USING (code) GROUP BY sel.cluster), near AS (SELECT a.cluster, b.cluster AS related, min(round(1 - w.corr, 9)) AS d FROM both_ways w JOIN cl a ON a.code = w.code JOIN cl b ON b.code = w.peer WHERE a.cluster >= 2 AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
rkd AS (SELECT n.cluster, n.related, d, row_number() OVER (PARTITION BY n.cluster ORDER BY round(d, 12), best DESC NULLS LAST, n.related) AS nth FROM near n JOIN best USING (related)) SELECT cluster, related, round(d, 6) AS distance, CAST(nth AS INTEGER) AS nth FROM rkd WHERE nth <= 3""",
}.items()}

_LIKE = _PAIRS.replace("overlap < 120", f"overlap < {DAYS}")
_CANDIDATES = ORACLE_SQL["p14_candidates"]
_CANDIDATES = _CANDIDATES[: _CANDIDATES.rindex("SELECT code, cluster, round(score")].replace(other_sql(_START), other_sql(f"{_START},{_LIKE}")).replace("WITH", "WITH RECURSIVE", 1)
_PLACE = ORACLE_SQL["p14_candidates"].split("CAST(row_number() OVER (")[-1].split(") AS INTEGER) AS place")[0]
ORACLE_SQL |= {name: other_sql(text) for name, text in {
    # one code after the other: the codes and groups kept so far are lists
    "p14_greedy_choice": f"""{_CANDIDATES}, pl AS (SELECT code, row_number() OVER ({_PLACE}) AS place FROM cand),
pc AS (SELECT a.cluster, avg(c.corr) AS m FROM corr c JOIN cl a ON a.code = c.code_a JOIN cl b ON b.code = c.code_b AND b.cluster = a.cluster GROUP BY a.cluster), nn AS (SELECT cluster, count(*) AS n FROM cl GROUP BY cluster),
tn AS (SELECT nn.cluster, row_number() OVER (ORDER BY coalesce(pc.m, 1) DESC, n DESC, nn.cluster) AS turn FROM nn LEFT JOIN pc ON pc.cluster = nn.cluster),
wk AS (SELECT r.code, r.cluster, r.nth, r.days, coalesce(pl.place > 10, true) AS spare, row_number() OVER (ORDER BY coalesce(pl.place > 10, true), CASE WHEN pl.place <= 10 THEN pl.place END, turn, r.nth) AS walk FROM rk3 r JOIN tn ON tn.cluster = r.cluster LEFT JOIN pl ON pl.code = r.code),
cf AS (SELECT a.code, list(b.code) AS foes FROM wk a JOIN both_ways w ON w.code = a.code JOIN wk b ON b.code = w.peer WHERE abs(w.corr) > CASE WHEN a.cluster = b.cluster THEN 0.6 ELSE 0.7 END GROUP BY a.code),
wf AS (SELECT wk.*, coalesce(foes, []) AS foes FROM wk LEFT JOIN cf ON cf.code = wk.code),
st AS (SELECT CAST(0 AS BIGINT) AS walk, CAST([] AS VARCHAR[]) AS kept, CAST([] AS INTEGER[]) AS have UNION ALL
  SELECT x.walk, CASE WHEN ok THEN list_append(kept, x.code) ELSE kept END, CASE WHEN ok THEN list_append(have, x.cluster) ELSE have END
  FROM (SELECT w.walk, w.code, CAST(w.cluster AS INTEGER) AS cluster, kept, have, len(list_intersect(w.foes, kept)) = 0 AND NOT (w.spare AND list_contains(have, CAST(w.cluster AS INTEGER))) AS ok FROM st JOIN wf w ON w.walk = st.walk + 1) x),
fin AS (SELECT unnest(kept) AS code, generate_subscripts(kept, 1) AS place FROM st WHERE walk = (SELECT max(walk) FROM st))
SELECT f.code, w.cluster, CAST(f.place AS INTEGER) AS place, 'multi_rep_exp_cluster_' || w.cluster || '_rank_' || w.nth || CASE WHEN w.spare THEN '_coverage_rescue' WHEN w.nth = 1 THEN '_coverage' ELSE '' END || CASE WHEN w.days < 180 THEN '_short_history' ELSE '' END AS reason FROM fin f JOIN wk w ON w.code = f.code""",
    "p15_trim": f"""{_START.replace("WITH", "WITH RECURSIVE", 1)},{_LIKE}, mn AS (SELECT code, round(avg(ret), 9) AS mean FROM recent GROUP BY code),
st AS (SELECT 0 AS step, code, mean, CAST(0 AS DOUBLE) AS most, false AS taken FROM mn UNION ALL
  SELECT step + 1, x.code, mean, CASE WHEN x.code <> pick THEN greatest(most, coalesce(abs(round(w.corr, 9)), 0)) ELSE most END, taken OR x.code = pick
  FROM (SELECT *, first_value(code) OVER (ORDER BY taken, most, mean DESC, code) AS pick, first_value(most) OVER (ORDER BY taken, most, mean DESC, code) AS least FROM st) x LEFT JOIN both_ways w ON w.code = x.code AND w.peer = pick WHERE step < 10 AND least <= 0.8)
SELECT code, CAST(min(step) AS INTEGER) AS nth FROM st WHERE taken GROUP BY code""",
    "j15_components": f"""{_START.replace("WITH", "WITH RECURSIVE", 1)},{_LIKE},{CLUSTER}, nb AS (SELECT w.code, w.peer, a.cluster FROM both_ways w JOIN cl a ON a.code = w.code JOIN cl b ON b.code = w.peer AND b.cluster = a.cluster WHERE w.corr >= {TOGETHER}),
reach AS (SELECT code, code AS other FROM cl UNION SELECT r.code, nb.peer FROM reach r JOIN nb ON nb.code = r.other), cp AS (SELECT r.code, cl.cluster, min(r.other) AS component FROM reach r JOIN cl ON cl.code = r.code GROUP BY r.code, cl.cluster),
pt AS (SELECT DISTINCT cluster, component, component = min(component) OVER (PARTITION BY cluster) AS first FROM cp), nm AS (SELECT *, CASE WHEN first THEN cluster ELSE max(cluster) OVER () + row_number() OVER (PARTITION BY first ORDER BY cluster, component) END AS split FROM pt)
SELECT cp.code, cp.cluster, CAST(nm.split AS INTEGER) AS split FROM cp JOIN nm ON nm.cluster = cp.cluster AND nm.component = cp.component""",
}.items()}
