"""A table of daily bars by month that changes by commits.

A change writes the months that it touches to a new folder and then one small file, the manifest of the next version, that
names the folder of every month. A manifest is moved to its place under a name that isn't taken, so of two writers one
fails and nothing of it is seen; a writer that dies before leaves files that no manifest names. Readers follow the newest
manifest, or any one before. A month is done once the table has a later one, and late or forced bars open it again by
writing it anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..streaming.bars import upsert

SCHEMA = "code string, date date, close double"


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass
class Manifest:
    """months: folder and last day of each; batches: the last batch of each stream that was committed."""

    version: int = 0
    months: dict[str, dict[str, str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def done(self) -> list[str]:
        return sorted(self.months)[:-1]


class BarTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    # ---- manifests

    def versions(self) -> list[int]:
        if not self._files.exists(self._at("commits")):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._files.listStatus(self._at("commits")) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest one, or that of a version; an empty table is version 0."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return Manifest()
        text = "".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.path}/commits/{version:012d}.json").collect())
        return Manifest(version, **json.loads(text))

    def _commit(self, new: Manifest) -> None:
        staged, target = self._at(f"staged/{uuid.uuid4().hex}.json"), self._at(f"commits/{new.version:012d}.json")
        out = self._files.create(staged)
        out.write(bytearray(json.dumps({"months": new.months, "batches": new.batches}, sort_keys=True).encode()))
        out.close()
        self._files.mkdirs(self._at("commits"))
        rename = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:  # fails where the name is taken
            self._hadoop.FileContext.getFileContext(self._files.getUri()).rename(staged, target, rename)
        except Exception as e:
            raise Conflict(f"version {new.version}") from e

    # ---- reading

    def read(self, months: list[str] | None = None, version: int | None = None) -> DataFrame:
        """(code, date, close), of some months only if they are named: folders of others aren't listed."""
        held = self.manifest(version).months
        paths = [f"{self.path}/{held[m]['folder']}" for m in sorted(held) if months is None or m in months]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    # ---- writing

    def merge(self, incoming: DataFrame, stream: str | None = None, batch: int | None = None) -> DataFrame:
        """Commits incoming (code, date, close, forced) and returns the status of each of its days: written, exists or skip
        (see ``upsert``). Only the months that have a day written are read and written anew. A batch of a stream that is
        committed already changes nothing."""
        from .checkpoints import stored

        before = self.manifest()
        month = F.date_format("date", "yyyy-MM")
        incoming = stored(incoming.select("code", "date", "close", "forced"))
        touched = sorted(r[0] for r in incoming.where("date IS NOT NULL").select(month).distinct().collect())  # of the calendar
        merged, status = upsert(self.read(touched), incoming.where("code IS NOT NULL AND date IS NOT NULL"))
        status = stored(status)
        if stream is not None and before.batches.get(stream, -1) >= batch:
            return status.limit(0)
        written = [(r["m"], r["d"]) for r in status.where("status = 'written'").groupBy(month.alias("m")).agg(F.max("date").cast("string").alias("d")).collect()]
        months, folder = dict(before.months), f"data/{uuid.uuid4().hex}"
        if written:
            names = [m for m, _ in written]
            rows = merged.withColumn("month", month).where(F.col("month").isin(names))
            rows.repartition("month").sortWithinPartitions("code", "date").write.partitionBy("month").parquet(f"{self.path}/{folder}")
            for m, day in written:
                months[m] = {"folder": f"{folder}/month={m}", "last": max(day, months.get(m, {}).get("last", ""))}
        if written or stream is not None:
            self._commit(Manifest(before.version + 1, months, before.batches | ({stream: batch} if stream is not None else {})))
        return status

    def follow(self, bars: DataFrame, stream: str, checkpoint: str) -> DataStreamWriter:
        """Merges each batch of a stream of (code, date, close, forced). The batch's number is in the manifest, so one that is
        run again, because the writer died between commit and checkpoint, isn't merged twice."""

        def write(rows: DataFrame, number: int) -> None:
            self.merge(rows, stream, number)

        return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

    # ---- resuming

    def pending(self, calendar: DataFrame) -> DataFrame:
        """(month, first, days): what is left to land of a calendar (date): whole months that aren't there, and the days after
        the last one of the month that isn't done."""
        held = self.manifest()
        known = self.spark.createDataFrame([(m, x["last"], m in held.done) for m, x in held.months.items()], "month string, last string, done boolean")  # a row a month
        days = calendar.select("date").distinct().withColumn("month", F.date_format("date", "yyyy-MM"))
        left = days.join(known, "month", "left").where("last IS NULL OR (NOT done AND date > CAST(last AS DATE))")
        return left.groupBy("month").agg(F.min("date").alias("first"), F.count("*").alias("days"))

    def unnamed(self, keep: int = 1) -> list[str]:
        """Folders of data that none of the last ``keep`` versions names: left by writers that died, or replaced since."""
        named = {x["folder"].split("/")[1] for v in self.versions()[-keep:] for x in self.manifest(v).months.values()}
        if not self._files.exists(self._at("data")):
            return []
        return sorted(n for s in self._files.listStatus(self._at("data")) if (n := s.getPath().getName()) not in named)
