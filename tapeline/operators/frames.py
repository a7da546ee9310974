"""Windows of a panel: the recent days with their changes, an evaluation window or all there is, and outer alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_changes(closes: DataFrame, lookback: int = 252) -> DataFrame:
    """(code, date, change) on the last ``lookback`` + 1 days of the calendar of all codes (code, date, close): the change
    from the calendar's day before, null where there is no close on either day, or where it is infinite."""
    days = closes.select("date").distinct()
    back = F.row_number().over(Window.orderBy(F.desc("date")))  # a row a day
    recent = days.withColumn("back", back).where(F.col("back") <= max(lookback + 1, 2))
    rows = closes.join(F.broadcast(recent), "date")
    order = Window.partitionBy("code").orderBy("date")
    before = F.when(F.lag("back").over(order) == F.col("back") + 1, F.lag("close").over(order))
    return rows.select("code", "date", (F.try_divide("close", before) - 1).alias("change"))


def evaluation_window(bars: DataFrame, first: str, last: str, least: int = 5) -> DataFrame:
    """``bars`` of each code between two days, with clipped = false; where these are fewer than ``least``, all its bars up to
    the last day, with clipped = true. Codes that have fewer even so have none."""
    upto = bars.where(F.col("date") <= F.lit(last).cast("date")).withColumn("_in", F.col("date") >= F.lit(first).cast("date"))
    whole = Window.partitionBy("code")
    rows = upto.withColumn("clipped", F.count_if("_in").over(whole) < least).withColumn("_n", F.count("*").over(whole))
    return rows.where((F.col("_n") >= least) & (F.col("clipped") | F.col("_in"))).drop("_in", "_n")


def need_against_realised(need: DataFrame, realised: DataFrame, bars: int = 20) -> DataFrame:
    """(code, date, need, need_period, realised, gap) of need (code, date, need: a year's return) and realised (code, date,
    realised: the return over so many bars), a row for each day that either has; gap is null where one is missing."""
    rows = need.select("code", "date", "need").join(realised.select("code", "date", "realised"), ["code", "date"], "full")
    period = F.pow(1 + F.col("need"), F.lit(bars / 252)) - 1
    return rows.withColumn("need_period", period).withColumn("gap", F.col("realised") - F.col("need_period")).select("code", "date", "need", "need_period", "realised", "gap")
