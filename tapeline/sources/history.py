"""Histories by code as a data source: ``spark.read.format("history")`` and ``spark.readStream.format("history")``.

What fetches is a function named by the option ``fetch``, as module:function of (options, code, first, last) that gives
(date, open, high, low, close, volume) of the days between two dates, either of which may be None. Each code is a partition.
A fetch that fails is tried again, after a wait that doubles. Read once, a code that fails for good is one row with its
error, so that others aren't lost with it; in a stream it fails the batch, which is read again, since the offset may not
pass over days that weren't fetched.

Filters on code and date reach the function where ``spark.sql.python.filterPushdown.enabled`` is set. Spark 4.1 keeps the
pushed filters with the loaded DataFrame, and without a filter it uses those of the query before: load anew for each read.
"""

from __future__ import annotations

import datetime
import importlib
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .checkpoints import stored

SCHEMA = "code string, date date, open double, high double, low double, close double, volume double, attempts int, error string"


@dataclass(frozen=True)
class Span(InputPartition):
    """One code between two days; None is open."""

    code: str
    first: datetime.date | None
    last: datetime.date | None


def fetched(options: dict, part: Span) -> tuple[list[tuple], int, str | None]:
    """(days, how often it was tried, the last error if all failed)."""
    module, name = options["fetch"].split(":")
    fetch, error = getattr(importlib.import_module(module), name), None
    attempts, wait = int(options.get("attempts", 3)), float(options.get("wait", 0.5))
    for k in range(attempts):
        try:
            return sorted(fetch(options, part.code, part.first, part.last)), k + 1, None
        except Exception as e:  # whatever a provider raises is reported
            error = f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                time.sleep(wait * 2**k)
    return [], attempts, error


class HistorySource(DataSource):
    """Options: codes (between commas), fetch, attempts, wait (seconds), for streams until (the last day that is complete)."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return HistoryStream(dict(self.options))


def asked(options: dict) -> list[str]:
    return list(dict.fromkeys(c.strip() for c in options["codes"].split(",") if c.strip()))


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.codes, self.first, self.last = options, asked(options), None, None

    def pushFilters(self, filters):
        """Codes that aren't asked for have no partition, and days outside aren't fetched."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("code",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.codes = [c for c in self.codes if c in wanted]
            elif at == ("date",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    day = f.value + datetime.timedelta(isinstance(f, GreaterThan))
                    self.first = max(self.first or day, day)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    day = f.value - datetime.timedelta(isinstance(f, LessThan))
                    self.last = min(self.last or day, day)
                yield f  # Spark tests the days again: errors have none
            else:
                yield f

    def partitions(self):
        return [Span(c, self.first, self.last) for c in self.codes]

    def read(self, partition: Span | None):
        if partition is None:  # no code is asked for
            return
        days, attempts, error = fetched(self.options, partition)
        yield from ((partition.code, *day, attempts, None) for day in days)
        if error:
            yield (partition.code, *[None] * 6, attempts, error)


class HistoryStream(DataSourceStreamReader):
    """Offsets are the last day that was read."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"day": "0001-01-01"}

    def latestOffset(self) -> dict:
        return {"day": self.options["until"]}

    def partitions(self, start: dict, end: dict):
        first = datetime.date.fromisoformat(start["day"]) + datetime.timedelta(1)
        last = datetime.date.fromisoformat(end["day"])
        return [Span(c, first, last) for c in asked(self.options)] if first <= last else []

    def read(self, partition: Span | None):
        if partition is None:  # no code is asked for
            return
        days, attempts, error = fetched(self.options, partition)
        if error:
            raise RuntimeError(f"{partition.code}: {error}")
        yield from ((partition.code, *day, attempts, None) for day in days)

    def commit(self, end: dict) -> None:
        pass


def landed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, report) of a read: the report has for each code its days, attempts and error. It is an error if codes were
    asked for and none succeeded; a code without days has succeeded."""
    kept = stored(rows)
    report = kept.groupBy("code").agg(F.count("date").alias("days"), F.max("attempts").alias("attempts"), F.max("error").alias("error"))
    known = report.agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.max("error").alias("error")).first()
    if known["n"] and known["failed"] == known["n"]:
        raise RuntimeError(f"none of {known['n']} histories came: {known['error']}")
    return kept.where("error IS NULL").drop("attempts", "error"), report


def event_days(options: dict, code: str, first: datetime.date | None, last: datetime.date | None):
    """Days of an event type of the table of events at the option ``path``, as bars of its values."""
    import pyarrow.dataset as ds

    test = ds.field("event_type") == code
    if first and first.year > 1:
        test &= ds.field("ts") >= datetime.datetime.combine(first, datetime.time())
    if last:
        test &= ds.field("ts") < datetime.datetime.combine(last + datetime.timedelta(1), datetime.time())
    table = ds.dataset(options["path"]).to_table(columns=["event_id", "ts", "value"], filter=test, use_threads=False)
    if not table.num_rows and first is None and last is None:
        raise KeyError(f"no history of {code}")
    day: dict[datetime.date, list[float]] = {}
    for row in table.sort_by([("ts", "ascending"), ("event_id", "ascending")]).to_pylist():
        day.setdefault(row["ts"].date(), []).append(row["value"])
    for d, v in day.items():
        yield d, v[0], max(v), min(v), v[-1], float(len(v))
