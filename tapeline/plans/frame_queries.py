"""Queries of windows of a panel, and their SQL for another engine, written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames
from ..sources.adapters import BARS
from .rule_queries import bars


def f05_recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes with holes and zeros, on the last 60 changes."""
    rows = bars(spark, sf_dir).where(F.dayofmonth("date") % 7 > 0).select("code", "date", F.when(F.dayofmonth("date") % 11 > 0, F.col("close")).otherwise(0.0).alias("close"))
    return frames.recent_changes(rows, 60).select("code", "date", F.round("change", 6).alias("change"))


def f11_evaluation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window that some codes don't reach."""
    rows = bars(spark, sf_dir).where("NOT (code LIKE 'E%' AND date > DATE'1997-06-30') AND NOT (code LIKE 'P%' AND date < DATE'1998-05-28')")
    return frames.evaluation_window(rows, "1998-03-01", "1998-05-31").select("code", "date", F.round("close", 6).alias("close"), "clipped")


def j07_need_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Need on two days of three, the return over the next 20 bars where there are so many."""
    rows = bars(spark, sf_dir)
    ahead = F.lead("close", 20).over(Window.partitionBy("code").orderBy("date")) / F.col("close") - 1
    need = rows.where(F.dayofmonth("date") % 3 > 0).select("code", "date", (F.dayofmonth("date") / 100).alias("need"))
    realised = rows.withColumn("realised", ahead).where("realised IS NOT NULL AND day(date) % 5 > 0")
    return frames.need_against_realised(need, realised).select("code", "date", *[F.round(c, 6).alias(c) for c in ("need", "need_period", "realised", "gap")])


QUERIES = {f.__name__: f for f in (f05_recent_changes, f11_evaluation_window, j07_need_gap)}

ORACLE_SQL = {
    "f05_recent_changes": f"""WITH {BARS}, h AS (SELECT code, date, CASE WHEN extract(day FROM date) % 11 > 0 THEN close ELSE 0 END AS close FROM bars WHERE extract(day FROM date) % 7 > 0),
dy AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM h ORDER BY date DESC LIMIT 61) x)
SELECT a.code, a.date, round(CASE WHEN b.close <> 0 THEN a.close / b.close - 1 END, 6) AS change FROM h a JOIN dy ON dy.date = a.date LEFT JOIN h b ON b.code = a.code AND b.date = dy.prev""",
    "f11_evaluation_window": f"""WITH {BARS}, h AS (SELECT * FROM bars WHERE NOT (code LIKE 'E%' AND date > DATE '1997-06-30') AND NOT (code LIKE 'P%' AND date < DATE '1998-05-28') AND date <= DATE '1998-05-31'),
n AS (SELECT code, count(*) AS n, count(*) FILTER (WHERE date >= DATE '1998-03-01') AS m FROM h GROUP BY code)
SELECT h.code, h.date, round(h.close, 6) AS close, n.m < 5 AS clipped FROM h JOIN n ON n.code = h.code WHERE n.n >= 5 AND (n.m < 5 OR h.date >= DATE '1998-03-01')""",
    "j07_need_gap": f"""WITH {BARS}, nd AS (SELECT code, date, extract(day FROM date) / 100.0 AS need FROM bars WHERE extract(day FROM date) % 3 > 0),
rl AS (SELECT * FROM (SELECT code, date, lead(close, 20) OVER (PARTITION BY code ORDER BY date) / close - 1 AS realised FROM bars) x WHERE realised IS NOT NULL AND extract(day FROM date) % 5 > 0),
al AS (SELECT coalesce(nd.code, rl.code) AS code, coalesce(nd.date, rl.date) AS date, CAST(need AS DOUBLE) AS need, pow(1 + CAST(need AS DOUBLE), 20 / 252.0) - 1 AS need_period, realised FROM nd FULL JOIN rl ON rl.code = nd.code AND rl.date = nd.date)
SELECT code, date, round(need, 6) AS need, round(need_period, 6) AS need_period, round(realised, 6) AS realised, round(realised - need_period, 6) AS gap FROM al""",
}
