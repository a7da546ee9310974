"""Queries of the walk-forward run, and SQL of its rules for another engine, written apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import other_sql
from ..functions.features import STEP1
from ..operators import walk
from ..sources.adapters import BARS
from .panel_sql import FORWARD
from .rule_queries import bars
from .views import view_query

#: Scored days made from the bars themselves, as input of the rules: z of the return, its cdf, and what follows from them.
SCORED = f"""
sz AS (SELECT code, date, rn, ret1, CASE WHEN count(ret1) OVER w = 20 THEN ret1 / nullif(stddev_samp(ret1) OVER w, 0) END AS z FROM feat WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
sc AS (SELECT *, round(0.5 + (atan(z / sqrt(CAST(5 AS DOUBLE))) + sin(atan(z / sqrt(CAST(5 AS DOUBLE)))) * (cos(atan(z / sqrt(CAST(5 AS DOUBLE)))) + CAST(2 AS DOUBLE) / 3 * power(cos(atan(z / sqrt(CAST(5 AS DOUBLE)))), CAST(3 AS DOUBLE)))) / pi(), 9) AS cdf FROM sz),
scored AS (SELECT s.code, s.date, ret1, round(z, 9) AS return_z, cdf AS pred_cdf, cdf >= 0.9 OR cdf <= 0.1 AS quantile_switch, CASE WHEN cdf >= 0.9 THEN 'up' WHEN cdf <= 0.1 THEN 'down' END AS switch_side, least(CAST(1 AS DOUBLE), round(abs(z) / 4, 9)) AS transition_score,
  CASE WHEN z > 0.5 THEN 'up' WHEN z < -0.5 THEN 'down' ELSE 'mixed' END AS direction, coalesce(z > 0.5, false) AS direction_up, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), round((z - 1) / 4, 9))) AS p_into_reversal_adj,
  greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), round((z - 1) / 3, 9))) AS p_into_reversal, extract(day FROM s.date) % 7 = 0 AS ambiguous, CASE WHEN extract(day FROM s.date) % 5 > 0 THEN round(cdf * 0.6, 6) END AS p_cal, l.label, @MONTH(s.date) AS month
  FROM sc s JOIN labelled l ON l.code = s.code AND l.date = s.date)"""
THRESHOLDS = ({"q_confirm": 0.56, "cdf_confirm": None, "z_confirm": None}, {"q_confirm": None, "cdf_confirm": 0.97, "z_confirm": None}, {"q_confirm": None, "cdf_confirm": None, "z_confirm": 2.5})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_query(f"WITH {BARS},{STEP1},{FORWARD},{SCORED} SELECT * FROM scored")(spark, sf_dir)


def f10_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("code", "date", walk.candidate().alias("is_candidate"))


def x23_signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels under three kinds of thresholds, and before the sixth month."""
    levels = [walk.signal_level(t, 6).alias(n) for n, t in zip(("by_score", "by_cdf", "by_z"), THRESHOLDS, strict=True)]
    return scored(spark, sf_dir).select("code", "date", *levels, walk.signal_level(THRESHOLDS[0], 5).alias("early"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day returns with some days twice: the second, made lower, counts."""
    rows = view_query(f"WITH {BARS},{STEP1} SELECT code, date, ret1 AS day_ret FROM feat")(spark, sf_dir)
    again = rows.where("day(date) % 9 = 0").select("code", "date", (F.col("day_ret") - 0.05).alias("day_ret"), F.lit(2).alias("place"))
    return rows.withColumn("place", F.lit(1)).unionByName(again)


def x24_extreme_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = walk.extreme_drops(scored(spark, sf_dir), returns(spark, sf_dir))
    return found.select("code", "date", F.round("day_ret", 6).alias("day_ret"), "extreme_drop", "quantile_switch", "switch_side", "switch_source")


def a16_coverage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walk.coverage(walk.extreme_drops(scored(spark, sf_dir), returns(spark, sf_dir)))
    return out.select("n_rows", *[F.round(c, 6).alias(c) for c in ("model_switch_rate", "extreme_rate", "effective_rate")], "n_extreme")


def x18_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cdf, density, mean and scale of three components whose weights and scales follow the volatility, by the function that
    scores days."""
    rows = view_query(f"WITH {BARS},{STEP1} SELECT code, date, ret1, rv20 / sqrt(CAST(252 AS DOUBLE)) AS s FROM feat WHERE rv20 > 0 AND ret1 IS NOT NULL")(spark, sf_dir)

    def run(frames):
        for g in frames:
            found = [walk.mixture(r, np.array([0.5, 0.3, 0.4]), np.array([0.0, -s / 2, s / 2]), np.array([s, 1.5 * s, 2 * s])) for r, s in zip(g.ret1, g.s, strict=True)]
            yield g[["code", "date"]].assign(**{c: [x[c] for x in found] for c in ("cdf", "log_density", "mean", "scale")})

    out = rows.mapInPandas(run, "code string, date date, cdf double, log_density double, mean double, scale double")
    return out.select("code", "date", F.round("cdf", 6).alias("cdf"), F.round("log_density", 5).alias("log_density"), F.round("mean", 7).alias("mean"), F.round("scale", 7).alias("scale"))


def f09_eligible_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = bars(spark, sf_dir).select("code", "date", F.when(F.dayofmonth("date") % 6 > 0, F.col("close")).alias("close"))
    return walk.eligible(gaps)


def w27_month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.month_ends(bars(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_query(f"WITH {BARS},{FORWARD} SELECT code, date, label FROM labelled")(spark, sf_dir)


def m13_frozen_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    out = walk.models(b, walk.month_ends(b))
    return out.select("code", "month", "train_end", "reliable", "ambiguous", "reasons", F.round("separation", 6).alias("separation"), *[F.transform(c, lambda x: F.round(x, 6)).cast("string").alias(c) for c in ("mu", "sigma")])


def p19_scored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored days of all months, under models frozen at the month before."""
    out = walk.walk_forward(bars(spark, sf_dir), labels(spark, sf_dir))
    return out.select("code", "month", "date", "regime_now", "prev_regime", "direction", "switch_side", "ambiguous", *[F.round(c, 6).alias(c) for c in ("transition_score", "p_into_reversal_adj", "p_state_reversal", "return_z", "pred_cdf")], "label")


def m20_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From bars to signals: models, scored days, cross-fitted and calibrated scores, thresholds and levels."""
    from ..sources.checkpoints import stored

    rows = stored(walk.walk_forward(bars(spark, sf_dir), labels(spark, sf_dir)))
    found, _ = walk.signals(rows)
    return found.select("code", "month", "date", "is_candidate", "signal_level", *[F.round(c, 5).alias(c) for c in ("p_raw", "p_cal")])


QUERIES = {f.__name__: f for f in (f10_candidates, x23_signal_levels, x24_extreme_drop, a16_coverage_split, x18_mixture, f09_eligible_days, w27_month_ends, m13_frozen_models, p19_scored_days, m20_walk_forward)}

# ---- the rules as SQL

_START = f"WITH {BARS},{STEP1},{FORWARD},{SCORED}"
_CAND = "(coalesce(quantile_switch, false) OR coalesce(return_z >= 1.5 AND direction_up, false) OR coalesce(p_into_reversal_adj >= 0.20, false) OR coalesce(transition_score >= 0.50 AND direction_up, false))"
_OBSERVE = "(coalesce(quantile_switch, false) OR coalesce(transition_score >= 0.70 AND direction = 'up' AND return_z >= 2, false))"
_OK = "(coalesce(quantile_switch, false) OR coalesce(p_into_reversal_adj >= 0.2, false) OR coalesce(transition_score >= 0.5 AND direction = 'up' AND return_z >= 1.5, false))"


def _level(confirm: str, floor: float) -> str:
    return f"""CASE WHEN p_cal IS NULL THEN CASE WHEN {_OBSERVE} THEN 'OBSERVE' ELSE 'NONE' END WHEN {confirm} THEN 'CONFIRM' WHEN {_OBSERVE} OR p_cal >= 0.28 THEN 'OBSERVE' WHEN p_into_reversal >= 0.2 AND p_cal < {floor} THEN 'REJECT_AS_ONE_DAY_JUMP' ELSE 'NONE' END"""


_UP_SWITCH = "coalesce(quantile_switch AND switch_side = 'up', false)"
_DROPS = f"""
r1 AS (SELECT code, date, ret1 AS day_ret, 1 AS place FROM feat UNION ALL SELECT code, date, ret1 - 0.05, 2 FROM feat WHERE extract(day FROM date) % 9 = 0),
r2 AS (SELECT code, date, arg_max(day_ret, place) AS day_ret FROM r1 WHERE day_ret IS NOT NULL GROUP BY code, date),
dr AS (SELECT s.code, s.date, r2.day_ret, coalesce(quantile_switch, false) AS m, coalesce(switch_side = 'down', false) AS down, coalesce(switch_side = 'up', false) AS up FROM scored s LEFT JOIN r2 ON r2.code = s.code AND r2.date = s.date),
de AS (SELECT *, coalesce(day_ret <= -0.07, false) AND NOT down AS x FROM dr)"""
_T = lambda m, s: f"atan((ret1 - ({m})) / ({s}) / sqrt(5.0))"
_PARTS = (("0.5", "0.0", "s"), ("0.3", "-s / 2", "s * 1.5"), ("0.4", "s / 2", "s * 2"))
_MEAN = "(0.3 * (-s / 2) + 0.4 * (s / 2)) / 1.2"
ORACLE_SQL = {
    "f10_candidates": f"{_START} SELECT code, date, {_CAND} AS is_candidate FROM scored",
    "x23_signal_levels": f"""{_START} SELECT code, date, {_level(f"p_cal >= 0.56 AND {_CAND} AND direction_up AND {_UP_SWITCH} AND {_OK} AND NOT ambiguous", 0.56)} AS by_score, {_level(f"pred_cdf >= 0.97 AND {_UP_SWITCH}", 0.28)} AS by_cdf,
  {_level(f"return_z >= 2.5 AND {_CAND} AND direction_up AND coalesce(quantile_switch, false) AND {_OK} AND NOT ambiguous", 0.28)} AS by_z, {_level("false", 0.56)} AS early FROM scored""",
    "x24_extreme_drop": f"{_START},{_DROPS} SELECT code, date, round(day_ret, 6) AS day_ret, x AS extreme_drop, m OR x AS quantile_switch, CASE WHEN down THEN 'down' WHEN up THEN 'up' WHEN x THEN 'down' END AS switch_side, CASE WHEN down OR up THEN 'quantile_tail' WHEN x THEN 'extreme_drop' ELSE '' END AS switch_source FROM de",
    "a16_coverage_split": f"{_START},{_DROPS} SELECT count(*) AS n_rows, round(avg(CAST(m AS INTEGER)), 6) AS model_switch_rate, round(avg(CAST(x AS INTEGER)), 6) AS extreme_rate, round(avg(CAST(m OR x AS INTEGER)), 6) AS effective_rate, count(*) FILTER (WHERE x) AS n_extreme FROM de",
    "x18_mixture": f"""WITH {BARS},{STEP1}, b AS (SELECT code, date, ret1, rv20 / sqrt(252.0) AS s FROM feat WHERE rv20 > 0 AND ret1 IS NOT NULL)
SELECT code, date, round({" + ".join(f"{w} / 1.2 * (0.5 + ({_T(m, s)} + sin({_T(m, s)}) * (cos({_T(m, s)}) + 2.0 / 3 * pow(cos({_T(m, s)}), 3))) / pi())" for w, m, s in _PARTS)}, 6) AS cdf,
  round(ln({" + ".join(f"{w} / 1.2 * 8 / (3 * pi() * sqrt(5.0)) * pow(1 + pow((ret1 - ({m})) / ({s}), 2) / 5, -3) / ({s})" for w, m, s in _PARTS)}), 5) AS log_density, round({_MEAN}, 7) AS mean,
  round(sqrt({" + ".join(f"{w} / 1.2 * (({s}) * ({s}) * 5.0 / 3 + pow(({m}) - {_MEAN}, 2))" for w, m, s in _PARTS)}), 7) AS scale FROM b""",
    "f09_eligible_days": f"""WITH {BARS}, g AS (SELECT code, date, CASE WHEN extract(day FROM date) % 6 > 0 THEN 1 END AS c FROM bars),
e AS (SELECT code, date, count(c) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS a, count(c) OVER (PARTITION BY code ORDER BY date ROWS 19 PRECEDING) AS b FROM g) SELECT code, date FROM e WHERE a >= 60 AND b >= 18""",
    "w27_month_ends": f"""WITH {BARS}, m AS (SELECT strftime(date, '%Y-%m') AS month, min(date) AS first_day, max(date) AS last_day FROM bars GROUP BY 1)
SELECT a.month, a.first_day, a.last_day, (SELECT max(date) FROM bars WHERE date < a.first_day) AS train_end FROM m a WHERE EXISTS (SELECT 1 FROM bars WHERE date < a.first_day)""",
}

ORACLE_SQL = {name: other_sql(text) for name, text in ORACLE_SQL.items()}
