"""Summaries of runs: merged by key, and whether a day is scored already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(before: DataFrame, now: DataFrame, key: str = "code") -> DataFrame:
    """A summary with one row a key: of ``now`` where it has the key, else of ``before``. Columns that one of them lacks are null."""
    kept = before.join(now.select(key).distinct(), key, "left_anti")
    return kept.unionByName(now, allowMissingColumns=True)


def already_scored(shard: DataFrame, signals: DataFrame, end: str, day: str = "as_of") -> bool:
    """Whether both tables reach the day ``end``; one aggregate of each."""
    last = [df.agg((F.max(F.col(day).cast("date")) >= F.lit(end).cast("date")).alias("x")).first()["x"] for df in (shard, signals)]
    return all(bool(x) for x in last)
