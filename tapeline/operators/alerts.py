"""Alerts matched to events.

An event takes all alerts of its series in its window that no earlier event took: the nearest becomes its match and the
others repeat it. So an alert belongs to the first event, by onset, whose window holds its day, whatever the other alerts
do, and events and alerts can meet in any order: each window is put into the buckets of days that it touches, alerts meet
the windows of their own bucket only, and the first onset is a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import business_day

#: Days of a bucket, so that a window touches two or three.
BUCKET = 16


def working_day_after(day: Column, ahead: int) -> Column:
    """The day so many working days later; weekends count as the Friday before."""
    weekday = F.weekday(day)
    start = F.when(weekday >= 5, F.date_sub(day, weekday - 4)).otherwise(day)
    weeks, rest = divmod(ahead, 5)
    return F.date_add(start, F.lit(7 * weeks) + F.when(F.weekday(start) + rest > 4, rest + 2).otherwise(rest))


def numbered(calendar: DataFrame) -> DataFrame:
    """(code, date, at): places of the days in each series' calendar."""
    days = calendar.select("code", "date").distinct()
    return days.withColumn("at", F.row_number().over(Window.partitionBy("code").orderBy("date")).cast("int"))


def matched(alerts: DataFrame, events: DataFrame, lead: int = 3, horizon: int = 10, calendar: DataFrame | None = None) -> DataFrame:
    """``alerts`` (code, date, score) with onset, delay, duplicate and false_alarm. events: (code, onset).

    Windows reach from ``lead`` working days before the onset to ``horizon`` working days after it, and delays are calendar
    days; with ``calendar`` (code, date) both are places in the calendar of the series, and what isn't in it matches
    nothing. The match is the nearest alert, then the earliest, then the highest; a missing or infinite score counts as 0.
    Repeated alerts are alerts of their own, of which one can be the match; repeated events are one. Alerts without code
    or date are false alarms."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    onsets = events.select("code", "onset").where("code IS NOT NULL AND onset IS NOT NULL").distinct()
    if calendar is None:
        rows = alerts.withColumn("at", day("date"))
        spans = onsets.select("code", "onset", day("onset").alias("on"), day(business_day(F.col("onset"), lead)).alias("low"), day(working_day_after(F.col("onset"), horizon)).alias("high"))
    else:
        places = numbered(calendar)
        rows = alerts.join(places, ["code", "date"], "left")
        spans = onsets.join(places.withColumnRenamed("date", "onset"), ["code", "onset"]).select("code", "onset", F.col("at").alias("on"), (F.col("at") - lead).alias("low"), (F.col("at") + horizon).alias("high"))
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket("low"), bucket("high"))))
    days = rows.select("code", "at").distinct().withColumn("bucket", bucket("at"))
    first = days.join(spans, ["code", "bucket"]).where("at BETWEEN low AND high").groupBy("code", "at").agg(F.min(F.struct("on", "onset")).alias("event"))
    out = rows.join(first, ["code", "at"], "left")
    score = F.coalesce(F.when((F.col("score") - F.col("score")) == 0, F.col("score")), F.lit(0.0))
    order = Window.partitionBy("code", "event.on").orderBy(F.abs(F.col("at") - F.col("event.on")), "at", F.desc(score))
    taken = F.col("event").isNotNull()
    best = taken & (F.row_number().over(order) == 1)
    return out.select(*alerts.columns, F.when(best, F.col("event.onset")).alias("onset"), F.when(best, F.col("at") - F.col("event.on")).alias("delay"), (taken & ~best).alias("duplicate"), (~taken).alias("false_alarm"))
