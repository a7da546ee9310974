"""Queries of what the scores were worth: cross-fit, calibration, thresholds, checks, alerts against events; and their SQL
for another engine, written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import other_sql
from ..functions.features import STEP1
from ..operators import alerts, calibration, filtering, transition, walk
from ..sources.adapters import BARS
from ..sources.checkpoints import folder, stored
from ..streaming.filter import filtered_stream
from .panel_sql import FORWARD
from .rule_queries import bars
from .views import view_query
from .walk_queries import _CAND, _OK, _START, THRESHOLDS, _level, scored

_ORDER = "PARTITION BY code ORDER BY date"
EVENTS = f"""
pos AS (SELECT code, date, rn, CASE WHEN rn - lag(rn) OVER ({_ORDER}) <= 5 THEN 0 ELSE 1 END AS edge FROM labelled WHERE label),
ev AS (SELECT *, sum(edge) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS ev FROM pos),
events_ AS (SELECT code, min(date) AS onset FROM ev GROUP BY code, ev)"""
NAMES = ["p_into_reversal_adj", "p_into_reversal", "transition_score", "return_z", "direction_up", "pred_cdf", "quantile_switch"]


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of upward tails with their score."""
    return scored(spark, sf_dir).where("quantile_switch AND switch_side = 'up'").select("code", "date", F.col("p_cal").alias("score"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_query(f"WITH {BARS},{FORWARD},{EVENTS} SELECT code, onset FROM events_")(spark, sf_dir)


def j11_alert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all series matched to events in windows of working days."""
    return alerts.matched(found(spark, sf_dir), events(spark, sf_dir)).select("code", "date", "onset", "delay", "duplicate", "false_alarm")


def p20_matches_by_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in windows of bars of each series, with wider ones ahead."""
    return alerts.matched(found(spark, sf_dir), events(spark, sf_dir), lead=5, horizon=15, calendar=bars(spark, sf_dir)).select("code", "date", "onset", "delay", "duplicate", "false_alarm")


def m15_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every month from a logistic fit to all months before it."""
    rows = scored(spark, sf_dir).select("code", "date", "month", "label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NAMES])
    return calibration.crossfit(rows, NAMES).select("code", "date", "month", F.round("p_raw", 6).alias("p_raw"), "train_months")


def m16_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores passed through their isotonic fit."""
    rows = scored(spark, sf_dir).select("code", "date", "label", F.round("pred_cdf", 3).alias("score"))
    out, done = calibration.calibrated(rows, "score", "label")
    return out.select("code", "date", "score", F.round("p_cal", 6).alias("p_cal"), F.lit(done).alias("fitted"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("is_candidate", walk.candidate()).where("is_candidate AND label IS NOT NULL AND p_cal IS NOT NULL")


def m17_fdr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score with its support, its share of false alarms and the bound of that, and the one that is chosen."""
    judged = calibration.judged_thresholds(pool(spark, sf_dir)).where("n >= 30")
    target = 0.8  # labels of these bars hardly follow from the score
    chosen = F.col("score") == F.lit(calibration.fdr_threshold(judged, target)["q_confirm"])
    return judged.select("score", "n", F.round("false_share", 6).alias("false_share"), F.round("upper", 6).alias("upper"), F.coalesce(chosen, F.lit(False)).alias("chosen"))


def m18_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rungs that will do, in their order."""
    rungs, _ = calibration.ladder(pool(spark, sf_dir))
    return rungs.select("kind", F.round("value", 9).alias("value"), "n", F.round("precision", 6).alias("precision"), "beats", "place")


def a15_go_no_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a run in one row."""
    rows = scored(spark, sf_dir).withColumns({"is_candidate": walk.candidate(), "signal_level": walk.signal_level(THRESHOLDS[2], 6)})
    got = calibration.go_no_go(rows)
    number = lambda x: None if x is None or x != x else round(float(x), 6)
    numbers = ("switch_rate", "precision", "precision_z", "lift", "lift_low", "brier", "ece", "false_per_code_year")
    row = {**{f"ok_{k}": bool(v) for k, v in got["checks"].items()}, **{k: number(got[k]) for k in numbers}, **{k: int(got[k]) for k in ("n_confirm", "n_observe", "n_rated")}, "pass": bool(got["pass"])}
    schema = ", ".join(f"{k} {'double' if k in numbers else 'boolean' if isinstance(v, bool) else 'long'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema)


#: Readings made from the bars themselves, as input of the rules.
READINGS = f"""
rd AS (SELECT code, date, ret1 AS now, CASE WHEN count(ret1) OVER ({_ORDER} ROWS 19 PRECEDING) = 20 THEN stddev_samp(ret1) OVER ({_ORDER} ROWS 19 PRECEDING) END AS std20, avg(ret1) OVER ({_ORDER} ROWS 4 PRECEDING) AS mean5, avg(ret1) OVER ({_ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean5_before,
  ret1 / nullif(stddev_samp(ret1) OVER ({_ORDER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS return_z, avg(ret1) OVER ({_ORDER} ROWS 9 PRECEDING) AS m10, extract(day FROM date) AS dd FROM feat),
readings AS (SELECT code, date, now, std20, mean5, mean5_before, return_z, CASE WHEN dd % 3 = 0 THEN 'calm' WHEN mean5_before < 0 THEN 'bear_grind' ELSE 'volatile_reversal' END AS prev, CASE WHEN m10 < -0.001 THEN 'bear_grind' WHEN m10 > 0.001 THEN 'volatile_reversal' ELSE 'calm' END AS raw,
  CAST(dd AS DOUBLE) / 40 AS p_transition, least(abs(return_z), CAST(9 AS DOUBLE)) AS emission_surprise, dd % 2 = 0 AS separated, CAST(dd AS DOUBLE) / 100 AS p_into_reversal, CASE WHEN dd % 4 > 0 THEN 0.5 + 0.5 * return_z / (1 + abs(return_z)) END AS pred_cdf FROM rd WHERE std20 > 0)"""


def x21_transition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump, rule and tail scores of every bar, what they say together, and its direction."""
    rows = view_query(f"WITH {BARS},{STEP1},{READINGS} SELECT * FROM readings")(spark, sf_dir)
    rows = rows.withColumns({"jump": transition.jump_score(), "rule": transition.rule_score(), "evidence": transition.jump_evidence()})
    out = transition.with_rules(rows)
    return out.select("code", "date", *[F.round(c, 6).alias(c) for c in ("jump", "rule", "evidence", "transition_score", "p_into_reversal_adj")], "regime_now", "prev_regime", "direction", "switch_side")


#: A fixed model of each code: states are thirds of its returns by size, in the order calm, lower mean, higher mean.
MODELS = """
m1 AS (SELECT code, date, ret1, rn, row_number() OVER (PARTITION BY code ORDER BY abs(ret1), date) AS place, count(*) OVER (PARTITION BY code) AS n FROM feat WHERE ret1 IS NOT NULL),
m2 AS (SELECT code, least(2, floor((place - 1) * 3 / CAST(n AS DOUBLE))) AS third, avg(ret1) AS mu, stddev_samp(ret1) AS sigma FROM m1 GROUP BY code, least(2, floor((place - 1) * 3 / CAST(n AS DOUBLE)))),
m3 AS (SELECT code, third, mu, sigma, CASE WHEN third = 0 THEN 0 ELSE row_number() OVER (PARTITION BY code, third = 0 ORDER BY mu) END AS s FROM m2),
model AS (SELECT code, max(CASE WHEN s = 0 THEN mu END) AS mu0, max(CASE WHEN s = 1 THEN mu END) AS mu1, max(CASE WHEN s = 2 THEN mu END) AS mu2, max(CASE WHEN s = 0 THEN sigma END) AS sg0, max(CASE WHEN s = 1 THEN sigma END) AS sg1, max(CASE WHEN s = 2 THEN sigma END) AS sg2 FROM m3 GROUP BY code)"""
TRANS = ((0.9, 0.06, 0.04), (0.1, 0.8, 0.1), (0.05, 0.2, 0.75))


#: A model of each code and month: states are its returns by size under two limits, so some months lack one.
MONTHLY = """
q1 AS (SELECT code, @MONTH(date) AS month, ret1, CASE WHEN abs(ret1) < 0.012 THEN 0 WHEN abs(ret1) < 0.024 THEN 1 ELSE 2 END AS s FROM feat WHERE ret1 IS NOT NULL),
q2 AS (SELECT code, month, s, avg(ret1) AS mu, stddev_samp(ret1) AS sigma, count(*) AS n FROM q1 GROUP BY code, month, s HAVING count(*) > 1),
q3 AS (SELECT code, month, median(abs(ret1)) AS typical FROM q1 GROUP BY code, month),
q4 AS (SELECT code, month, count(*) AS states, max(CASE WHEN s = 0 THEN mu END) AS mu0, max(CASE WHEN s = 1 THEN mu END) AS mu1, max(CASE WHEN s = 2 THEN mu END) AS mu2, max(CASE WHEN s = 0 THEN sigma END) AS sg0, max(CASE WHEN s = 1 THEN sigma END) AS sg1, max(CASE WHEN s = 2 THEN sigma END) AS sg2,
  max(CASE WHEN s = 0 THEN n END) AS n0, max(CASE WHEN s = 1 THEN n END) AS n1, max(CASE WHEN s = 2 THEN n END) AS n2 FROM q2 GROUP BY code, month),
q5 AS (SELECT q3.code, q3.month, typical, coalesce(states = 3, false) AS reliable, mu0, mu1, mu2, sg0, sg1, sg2, CAST(n0 AS DOUBLE) AS n0, CAST(n1 AS DOUBLE) AS n1, CAST(n2 AS DOUBLE) AS n2, sg1 / sg0 AS separation FROM q3 LEFT JOIN q4 ON q4.code = q3.code AND q4.month = q3.month)"""


def m12_model_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubts about a model of each month, each held against the month before."""
    rows = view_query(f"WITH {BARS},{STEP1},{MONTHLY} SELECT code, month, typical, reliable, CAST(NULL AS STRING) AS failure, separation, array(mu0, mu1, mu2) AS mu, array(sg0, sg1, sg2) AS sigma, array(n0, n1, n2) AS mass FROM q5")(spark, sf_dir)
    return transition.with_doubts(rows, drift=True).select("code", "month", "reliable", "reasons", "ambiguous")


def m14_state_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the states at every bar from its last 41 returns, the chance of a change, and the weights at the next bar."""
    rows = view_query(f"WITH {BARS},{STEP1},{MODELS} SELECT m1.code, date, ret1, place, m1.rn, array(mu0, mu1, mu2) AS mu, array(sg0, sg1, sg2) AS sigma FROM m1 JOIN model ON model.code = m1.code")(spark, sf_dir)
    last = Window.partitionBy("code").orderBy("date").rowsBetween(-40, 0)
    rows = rows.withColumn("returns", F.collect_list("ret1").over(last)).where(F.size("returns") == 41).withColumn("trans", F.array(*[F.lit(x) for row in TRANS for x in row]))
    out = filtering.with_summaries(rows)
    parts = {f"{name}_{i}": F.round(F.col(c)[i], 6) for c, name in (("state", "now"), ("next", "next")) for i in range(3)}
    return out.select("code", "date", F.round("p_switch", 6).alias("p_switch"), F.round("p_into_reversal", 6).alias("p_into_reversal"), *[c.alias(n) for n, c in parts.items()], F.round("stay10", 6).alias("stay10"))


def t07_filtered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the states along a stream of returns in several batches, stopped and started again in between."""
    at = folder(spark)
    start = f"WITH {BARS},{STEP1},{MODELS}"
    models = stored(view_query(f"{start} SELECT code, array(mu0, mu1, mu2) AS mu, array(sg0, sg1, sg2) AS sigma FROM model")(spark, sf_dir).withColumns({"trans": F.array(*[F.lit(x) for row in TRANS for x in row]), "start": F.array(*[F.lit(1 / 3)] * 3)}))
    rows = stored(view_query(f"{start} SELECT code, date, ret1 AS r FROM m1")(spark, sf_dir))
    for part in ("date < DATE'1995-12-20'", "date >= DATE'1995-12-10' AND date < DATE'1998-02-01'", "date >= DATE'1998-02-01'"):  # the second comes with days that were seen
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{at}/in")
        given = spark.readStream.schema("code string, date date, r double").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        filtered_stream(given, models).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.select("code", "date", *[F.round(c, 6).alias(c) for c in ("calm", "bear_grind", "volatile_reversal")])


QUERIES = {f.__name__: f for f in (j11_alert_matches, p20_matches_by_bars, m15_crossfit, m16_isotonic, m17_fdr_threshold, m18_ladder, a15_go_no_go, x21_transition_rules, m12_model_doubts, m14_state_summaries, t07_filtered_stream)}

# ---- the rules as SQL

_POOL = f"pool AS (SELECT * FROM scored WHERE {_CAND} AND label IS NOT NULL AND p_cal IS NOT NULL)"
_MATCH = """
al AS (SELECT code, date, coalesce(p_cal, 0) AS score FROM scored WHERE quantile_switch AND switch_side = 'up'),
m AS (SELECT a.code, a.date, min(s.onset) AS ev FROM al a JOIN spans s ON s.code = a.code AND {inside} GROUP BY a.code, a.date),
mt AS (SELECT a.code, a.date, m.ev, {delay} AS delay, row_number() OVER (PARTITION BY a.code, m.ev ORDER BY abs({delay}), a.date, a.score DESC) AS nth FROM al a LEFT JOIN m ON m.code = a.code AND m.date = a.date {more})
SELECT code, date, CASE WHEN nth = 1 THEN ev END AS onset, CASE WHEN nth = 1 AND ev IS NOT NULL THEN CAST(delay AS INTEGER) END AS delay, ev IS NOT NULL AND nth > 1 AS duplicate, ev IS NULL AS false_alarm FROM mt"""
_DRAWN = """
mo AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS place FROM (SELECT DISTINCT month FROM {rows}) x),
rep AS (SELECT DISTINCT b AS replicate, o.month FROM mo m, (SELECT unnest(generate_series(1, 200)) AS b) r JOIN mo o ON o.place = CAST('0x' || substr(md5('42|' || r.b || '|' || m.place), 1, 7) AS BIGINT) % (SELECT count(*) FROM mo))"""
_JUMPS = """
rx AS (SELECT *, abs(now) / std20 AS size FROM readings),
ry AS (SELECT *, size >= 2.5 AS jumps, least(1, size / 3.75) AS scale, (now > 0) <> (mean5_before > 0) OR abs(mean5_before) < 1e-12 AS against, CASE WHEN pred_cdf >= 0.9 THEN 'up' WHEN pred_cdf <= 0.1 THEN 'down' END AS side FROM rx),
rz AS (SELECT *, CASE WHEN NOT jumps THEN 0 WHEN prev = 'bear_grind' AND now > 0 THEN 0.85 * scale WHEN prev = 'volatile_reversal' AND now < 0 THEN 0.7 * scale WHEN against THEN 0.6 * scale ELSE 0.35 * scale END AS jump,
  CASE WHEN NOT jumps THEN NULL WHEN prev = 'bear_grind' AND now > 0 THEN 'volatile_reversal' WHEN prev = 'volatile_reversal' AND now < 0 THEN 'bear_grind' WHEN against AND now > 0 THEN 'volatile_reversal' END AS means,
  CASE WHEN NOT separated AND size > 2.5 AND ((now > 0) <> (mean5 > 0) OR abs(mean5) < 1e-12) THEN 0.7 ELSE 0 END AS rule, CASE WHEN now > 0 AND return_z >= 2.5 THEN least(1, (return_z - 2.5) / 2.5) ELSE 0 END AS evidence,
  CASE side WHEN 'up' THEN 0.5 + 0.5 * least(1, (pred_cdf - 0.9) / 0.1) WHEN 'down' THEN 0.5 + 0.5 * least(1, (0.1 - pred_cdf) / 0.1) ELSE 0 END AS tail FROM ry),
rw AS (SELECT *, coalesce(CASE side WHEN 'up' THEN 'volatile_reversal' WHEN 'down' THEN 'bear_grind' END, means, raw) AS regime FROM rz)"""

_DENSITY = lambda i: f"pow(1 + pow((b.ret1 - mu{i}) / sg{i}, 2) / 5, -3) / sg{i}"
_MOVED = lambda j: f"(a0 * {TRANS[0][j]} + a1 * {TRANS[1][j]} + a2 * {TRANS[2][j]}) * {_DENSITY(j)}"
# one return after the other, brought to a sum of one each time
_FILTER = f"""
bs AS (SELECT m1.code, m1.date, m1.ret1, row_number() OVER (PARTITION BY m1.code ORDER BY m1.date) AS k, md.* EXCLUDE (code) FROM m1 JOIN model md ON md.code = m1.code),
fl AS (SELECT code, k AS bar, 0 AS steps, CAST(1 AS DOUBLE) / 3 AS a0, CAST(1 AS DOUBLE) / 3 AS a1, CAST(1 AS DOUBLE) / 3 AS a2 FROM bs WHERE k >= 41 UNION ALL
  SELECT code, bar, steps, w0 / (w0 + w1 + w2), w1 / (w0 + w1 + w2), w2 / (w0 + w1 + w2) FROM (SELECT f.code, f.bar, f.steps + 1 AS steps, {_MOVED(0)} AS w0, {_MOVED(1)} AS w1, {_MOVED(2)} AS w2 FROM fl f JOIN bs b ON b.code = f.code AND b.k = f.bar - 40 + f.steps WHERE f.steps < 40) x),
jt AS (SELECT b.code, b.date, {", ".join(f"a{i} * {TRANS[i][j]} * {_DENSITY(j)} AS j{i}{j}" for i in range(3) for j in range(3))} FROM fl f JOIN bs b ON b.code = f.code AND b.k = f.bar WHERE f.steps = 40),
js AS (SELECT *, {" + ".join(f"j{i}{j}" for i in range(3) for j in range(3))} AS total FROM jt),
st3 AS (SELECT *, {", ".join(f"(j0{j} + j1{j} + j2{j}) / total AS s{j}" for j in range(3))} FROM js)"""

_GAP = lambda a, b: f"(abs(mu{a} - lag(CASE WHEN reliable THEN mu{b} END) OVER w) + abs(sg{a} - lag(CASE WHEN reliable THEN sg{b} END) OVER w))"

ORACLE_SQL = {
    "m12_model_doubts": f"""WITH {BARS},{STEP1},{MONTHLY}, t AS (SELECT *, separation < 1.15 AS a, abs(mu1 - mu2) < 0.25 * greatest(typical, 1e-12) AS b, least(n0, n1, n2) / (n0 + n1 + n2) < 0.02 AS c, CAST(n0 / (n0 + n1 + n2) >= 0.02 AS INT) + CAST(n1 / (n0 + n1 + n2) >= 0.02 AS INT) + CAST(n2 / (n0 + n1 + n2) >= 0.02 AS INT) < 2 AS d,
  coalesce({_GAP(1, 2)} + 1e-12 < {_GAP(1, 1)} OR {_GAP(2, 1)} + 1e-12 < {_GAP(2, 2)}, false) AS e FROM q5 WINDOW w AS (PARTITION BY code ORDER BY month))
SELECT code, month, reliable, CASE WHEN NOT reliable THEN 'fit_unreliable' ELSE concat_ws('|', CASE WHEN a THEN 'sigma_not_separated' END, CASE WHEN b THEN 'direction_mu_not_separated' END, CASE WHEN c THEN 'low_effective_state_mass' END, CASE WHEN d THEN 'single_state_collapse' END, CASE WHEN e THEN 'semantic_label_drift' END) END AS reasons,
  NOT reliable OR d OR e OR (a AND b) AS ambiguous FROM t""",
    "t07_filtered_stream": f"""{f"WITH {BARS},{STEP1},{MODELS},{_FILTER}".split("fl AS (")[0].rstrip().rstrip(",").replace("WITH", "WITH RECURSIVE", 1)},
fl AS (SELECT code, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) / 3 AS a0, CAST(1 AS DOUBLE) / 3 AS a1, CAST(1 AS DOUBLE) / 3 AS a2 FROM model UNION ALL
  SELECT code, k, w0 / (w0 + w1 + w2), w1 / (w0 + w1 + w2), w2 / (w0 + w1 + w2) FROM (SELECT f.code, b.k, {_MOVED(0)} AS w0, {_MOVED(1)} AS w1, {_MOVED(2)} AS w2 FROM fl f JOIN bs b ON b.code = f.code AND b.k = f.k + 1) x)
SELECT f.code, b.date, round(a0, 6) AS calm, round(a1, 6) AS bear_grind, round(a2, 6) AS volatile_reversal FROM fl f JOIN bs b ON b.code = f.code AND b.k = f.k""",
    "m14_state_summaries": f"""{f"WITH {BARS},{STEP1},{MODELS},{_FILTER}".replace("WITH", "WITH RECURSIVE", 1)}
SELECT code, date, round(1 - (j00 + j11 + j22) / total, 6) AS p_switch, round((j02 + j12) / total, 6) AS p_into_reversal, {", ".join(f"round(s{j}, 6) AS now_{j}" for j in range(3))},
  {", ".join(f"round(s0 * {TRANS[0][j]} + s1 * {TRANS[1][j]} + s2 * {TRANS[2][j]}, 6) AS next_{j}" for j in range(3))}, round(pow(CAST({TRANS[2][2]} AS DOUBLE), 10), 6) AS stay10 FROM st3""",
    "j11_alert_matches": f"""{_START},{EVENTS}, spans AS (SELECT code, onset, list_filter(generate_series(onset - INTERVAL 1 DAY, onset - INTERVAL 12 DAY, -INTERVAL 1 DAY), lambda x: isodow(x) < 6)[3] AS low, list_filter(generate_series(onset + INTERVAL 1 DAY, onset + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)[10] AS high FROM events_),
{_MATCH.format(inside="a.date BETWEEN s.low AND s.high", delay="date_diff('day', m.ev, a.date)", more="")}""",
    "p20_matches_by_bars": f"""{_START},{EVENTS}, cal AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS place FROM bars), spans AS (SELECT e.code, e.onset, low.date AS low, high.date AS high FROM events_ e JOIN cal c ON c.code = e.code AND c.date = e.onset
  JOIN cal low ON low.code = e.code AND low.place = greatest(1, c.place - 5) JOIN (SELECT code, max(place) AS n FROM cal GROUP BY code) t ON t.code = e.code JOIN cal high ON high.code = e.code AND high.place = least(t.n, c.place + 15)),
{_MATCH.format(inside="a.date BETWEEN s.low AND s.high", delay="(ca.place - ce.place)", more="LEFT JOIN cal ca ON ca.code = a.code AND ca.date = a.date LEFT JOIN cal ce ON ce.code = a.code AND ce.date = m.ev")}""",
    # the isotonic mean at i is the largest, over starts a up to i, of the smallest mean from a to any end from i on
    "m16_isotonic": f"""{_START}, pts AS (SELECT round(pred_cdf, 3) AS x, count(*) AS n, sum(CAST(label AS INTEGER)) AS y FROM scored WHERE label IS NOT NULL AND pred_cdf IS NOT NULL GROUP BY 1),
cum AS (SELECT x, sum(n) OVER o AS n, sum(y) OVER o AS y, n AS own, y AS hits FROM pts WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
ab AS (SELECT a.x AS a, b.x AS b, (b.y - a.y + a.hits) / CAST(b.n - a.n + a.own AS DOUBLE) AS mean FROM cum a JOIN cum b ON a.x <= b.x),
low AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS v FROM ab), fit AS (SELECT i, max(v) AS v FROM low GROUP BY i),
q AS (SELECT quantile_cont(round(pred_cdf, 3), 0.8) AS q80, quantile_cont(round(pred_cdf, 3), 0.9) AS q90 FROM scored WHERE label IS NOT NULL AND pred_cdf IS NOT NULL),
ok AS (SELECT count(*) >= 500 AND sum(CAST(label AS INTEGER)) >= 50 AND count(DISTINCT label) = 2 AND count(*) FILTER (WHERE round(pred_cdf, 3) >= q90) >= 30 AND count(*) FILTER (WHERE round(pred_cdf, 3) >= q80 AND round(pred_cdf, 3) < q90) >= 30 AS ok FROM scored, q WHERE label IS NOT NULL AND pred_cdf IS NOT NULL)
SELECT code, date, round(pred_cdf, 3) AS score, round(CASE WHEN pred_cdf IS NULL THEN NULL WHEN ok THEN least(1, greatest(0, v)) ELSE round(pred_cdf, 3) END, 6) AS p_cal, ok AS fitted FROM scored CROSS JOIN ok LEFT JOIN fit ON fit.i = round(pred_cdf, 3)""",
    "m17_fdr_threshold": f"""{_START},{_POOL},{_DRAWN.format(rows="pool")},
cn AS (SELECT month, round(p_cal, 6) AS score, count(*) AS n, count(*) FILTER (WHERE NOT label) AS f FROM pool GROUP BY 1, 2), sa AS (SELECT score, sum(n) AS n, sum(f) AS f FROM cn GROUP BY score),
w AS (SELECT score, sum(n) OVER o AS n, sum(f) OVER o AS f FROM sa WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
dn AS (SELECT replicate, score, sum(n) AS n, sum(f) AS f FROM cn JOIN rep USING (month) GROUP BY 1, 2), g AS (SELECT score, b AS replicate FROM sa, (SELECT unnest(generate_series(1, 200)) AS b) r),
rn_ AS (SELECT g.score, sum(d.n) OVER o AS n, sum(d.f) OVER o AS f FROM g LEFT JOIN dn d ON d.replicate = g.replicate AND d.score = g.score WINDOW o AS (PARTITION BY g.replicate ORDER BY g.score DESC ROWS UNBOUNDED PRECEDING)),
u AS (SELECT score, quantile_cont(f / CAST(n AS DOUBLE), 0.95) FILTER (WHERE n > 0) AS upper FROM rn_ GROUP BY score),
j AS (SELECT w.score, w.n, w.f / CAST(w.n AS DOUBLE) AS false_share, u.upper FROM w JOIN u ON u.score = w.score WHERE w.n >= 30)
SELECT score, CAST(n AS BIGINT) AS n, round(false_share, 6) AS false_share, round(upper, 6) AS upper, coalesce(score = (SELECT max(score) FROM j WHERE upper <= 0.8), false) AS chosen FROM j""",
    "m18_ladder": f"""{_START},{_POOL}, f AS (SELECT count(*) AS n, avg(CAST(label AS INTEGER)) AS base, count(*) FILTER (WHERE return_z >= 2.5 AND direction_up) AS jumps, avg(CAST(label AS INTEGER)) FILTER (WHERE return_z >= 2.5 AND direction_up) AS jp FROM pool),
z AS (SELECT n AS pool_n, base, CASE WHEN jumps >= 10 THEN jp ELSE base END AS z FROM f),
st AS (SELECT 1 AS kind, v AS value, label FROM pool, (SELECT unnest([0.995, 0.99, 0.97, 0.95]) AS v) x WHERE pred_cdf >= v UNION ALL SELECT 3, v, label FROM pool, (SELECT unnest([4.0, 3.5, 3.0, 2.75, 2.5]) AS v) x WHERE return_z >= v AND direction_up AND NOT ambiguous),
pc AS (SELECT p_cal AS value, count(*) AS n, sum(CAST(label AS INTEGER)) AS hits FROM pool GROUP BY 1),
rg AS (SELECT kind, CAST(value AS DOUBLE) AS value, count(*) AS n, sum(CAST(label AS INTEGER)) AS hits FROM st GROUP BY 1, 2 UNION ALL SELECT 2, value, sum(n) OVER (ORDER BY value DESC), sum(hits) OVER (ORDER BY value DESC) FROM pc),
jd AS (SELECT kind, value, n, hits / CAST(n AS DOUBLE) AS p, hits / CAST(n AS DOUBLE) >= z + 0.05 AS beats FROM rg, z WHERE pool_n >= CASE kind WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE 0 END AND n >= CASE kind WHEN 1 THEN 15 ELSE 20 END
  AND (hits / CAST(n AS DOUBLE) >= z + 0.05 OR hits / CAST(n AS DOUBLE) >= CASE kind WHEN 3 THEN z ELSE greatest(base + 0.05, z) END))
SELECT kind, round(value, 9) AS value, CAST(n AS BIGINT) AS n, round(p, 6) AS precision, beats, CAST(row_number() OVER (ORDER BY kind, beats DESC, p DESC, value) AS INTEGER) AS place FROM jd""",
    "a15_go_no_go": f"""{_START}, lv AS (SELECT *, {_CAND} AS cand, return_z >= 2.5 AND direction_up AS jump, {_level(f"return_z >= 2.5 AND {_CAND} AND direction_up AND coalesce(quantile_switch, false) AND {_OK} AND NOT ambiguous", 0.28)} AS level FROM scored),
kn AS (SELECT *, level = 'CONFIRM' AS conf FROM lv WHERE label IS NOT NULL),{_DRAWN.format(rows="kn")},
on_ AS (SELECT count(*) FILTER (WHERE conf) AS c, count(*) FILTER (WHERE conf AND label) AS ch, count(*) FILTER (WHERE jump) AS z, count(*) FILTER (WHERE jump AND label) AS zh, count(*) FILTER (WHERE jump AND cand) AS zc, count(*) FILTER (WHERE jump AND cand AND label) AS zch, count(*) FILTER (WHERE cand) AS cands,
  max(year(date)) FILTER (WHERE conf) - min(year(date)) FILTER (WHERE conf) + 1 AS years, count(*) FILTER (WHERE cand AND p_cal IS NOT NULL) AS rated, avg(pow(p_cal - CAST(label AS INTEGER), 2)) FILTER (WHERE cand AND p_cal IS NOT NULL) AS brier FROM kn),
al AS (SELECT avg(CAST(coalesce(quantile_switch, false) AS INTEGER)) AS rate, count(DISTINCT code) AS codes, count(*) FILTER (WHERE level = 'OBSERVE') AS n_observe FROM lv),
bn AS (SELECT sum(n * gap) AS off FROM (SELECT count(*) AS n, abs(avg(CAST(label AS INTEGER)) - avg(p_cal)) AS gap FROM kn WHERE cand AND p_cal IS NOT NULL GROUP BY least(4, floor(p_cal * 5))) x),
rs AS (SELECT replicate, count(*) FILTER (WHERE conf) AS c, count(*) FILTER (WHERE conf AND label) AS ch, count(*) FILTER (WHERE jump) AS z, count(*) FILTER (WHERE jump AND label) AS zh, count(*) FILTER (WHERE jump AND cand) AS zc, count(*) FILTER (WHERE jump AND cand AND label) AS zch, count(*) FILTER (WHERE cand) AS cands FROM kn JOIN rep USING (month) GROUP BY replicate),
lo AS (SELECT quantile_cont(ch / CAST(c AS DOUBLE) - b / CAST(a AS DOUBLE), 0.025) AS low FROM (SELECT *, CASE WHEN cands >= 20 THEN zc ELSE z END AS a, CASE WHEN cands >= 20 THEN zch ELSE zh END AS b FROM rs) x WHERE c >= 5 AND a >= 5),
v AS (SELECT *, CASE WHEN c >= 10 THEN ch / CAST(c AS DOUBLE) END AS prec, CASE WHEN cands >= 50 THEN zch / nullif(CAST(zc AS DOUBLE), 0) ELSE zh / nullif(CAST(z AS DOUBLE), 0) END AS pz, off / nullif(CAST(rated AS DOUBLE), 0) AS e, CASE WHEN c >= 10 AND CASE WHEN cands >= 50 THEN zc ELSE z END >= 10 THEN low END AS l FROM on_, al, bn, lo),
t AS (SELECT *, rate BETWEEN 0.08 AND 0.35 AS k1, coalesce(c = 0 OR (prec - pz >= 0.05 AND (coalesce(l > 0, false) OR c >= 15)) OR (prec >= pz AND prec >= 0.3 AND c >= 20), false) AS k2, coalesce(rated >= 50 AND brier <= 0.25 AND e <= 0.15, false) AS k3, CASE WHEN c = 0 THEN 0 ELSE (c - ch) / CAST(greatest(years, 1) AS DOUBLE) / greatest(codes, 1) END AS fp, c = 0 OR c >= 10 AS k5 FROM v)
SELECT k1 AS ok_switch_coverage, k2 AS ok_precision, k3 AS ok_calibration, fp <= 4 AS ok_false_alarms, k5 AS ok_threshold, round(rate, 6) AS switch_rate, round(prec, 6) AS precision, round(pz, 6) AS precision_z, round(prec - pz, 6) AS lift, round(l, 6) AS lift_low, round(brier, 6) AS brier, round(e, 6) AS ece,
  round(CAST(fp AS DOUBLE), 6) AS false_per_code_year, c AS n_confirm, n_observe, rated AS n_rated, k1 AND k2 AND k3 AND fp <= 4 AND k5 AS pass FROM t""",
    "x21_transition_rules": f"""WITH {BARS},{STEP1},{READINGS},{_JUMPS}
SELECT code, date, round(CAST(jump AS DOUBLE), 6) AS jump, round(CAST(rule AS DOUBLE), 6) AS rule, round(CAST(evidence AS DOUBLE), 6) AS evidence, round(CAST(least(1, greatest(p_transition * least(emission_surprise / 2, 3) * CASE WHEN separated THEN 1 ELSE 0.5 END, rule, jump, tail)) AS DOUBLE), 6) AS transition_score,
  round(CAST(greatest(p_into_reversal, evidence, CASE WHEN side = 'up' THEN tail ELSE 0 END) AS DOUBLE), 6) AS p_into_reversal_adj, regime AS regime_now, CASE WHEN prev <> regime THEN prev END AS prev_regime,
  CASE WHEN side IS NOT NULL THEN side WHEN jump > 0 AND means = 'volatile_reversal' THEN 'up' WHEN jump > 0 AND means IS NOT NULL THEN 'down' WHEN prev <> regime AND regime = 'volatile_reversal' AND now > 0 THEN 'up' WHEN prev <> regime AND regime = 'bear_grind' AND now < 0 THEN 'down' ELSE 'mixed' END AS direction, side AS switch_side FROM rw""",
}
ORACLE_SQL = {name: other_sql(text) for name, text in ORACLE_SQL.items()}
