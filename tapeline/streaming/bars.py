"""Bars from events and a log of bar upserts, for batch tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _watermarked(events: DataFrame, delay: str) -> DataFrame:
    """A stream's times become instants of the session's time zone, as a watermark asks for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def event_bars(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """One bar for each event type and window: event_type, hour, open, high, low, close, n. In a stream, events later
    than ``delay`` are left out, and a bar is final once the watermark has passed it."""
    order = F.struct("ts", "event_id")
    seen = _watermarked(events, delay)
    bars = seen.groupBy("event_type", F.window("ts", width).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")
    )
    return bars.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "open", "high", "low", "close", "n")


def sessions(events: DataFrame, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """Runs of a user's events without a longer gap: user_id, first_ts, n."""
    seen = _watermarked(events, delay)
    found = seen.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "n")


def append_log(bars: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes each batch of (code, date, close, forced) under its own number: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("close IS NOT NULL").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(log: DataFrame) -> DataFrame:
    """(code, date, close) as the log of (code, date, close, forced, batch) has it: the last forced bar of a day, or
    else the first one. Of bars of a batch the highest close counts."""
    newest = Window.partitionBy("code", "date").orderBy(F.col("forced").desc(), F.when(F.col("forced"), -F.col("batch")).otherwise(F.col("batch")), F.col("close").desc())
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("code", "date", "close")


def upsert(bars: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged bars, status of each incoming day) of bars (code, date, close) and incoming (code, date, close, forced).

    A day without close is skipped, one that is there stays unless forced, and of a day's incoming bars a forced one
    comes first, then the highest close."""
    order = Window.partitionBy("code", "date").orderBy(F.desc_nulls_last("close"))
    best = Window.partitionBy("code", "date").orderBy(F.col("close").isNull(), F.desc("forced"), F.desc("close"))
    new = incoming.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumnRenamed("close", "_new")
    old = bars.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").withColumn("_had", F.lit(True))
    rows = old.join(new, ["code", "date"], "full")
    status = F.when(F.col("_new").isNull(), "skip").when(F.coalesce("_had", F.lit(False)) & ~F.coalesce("forced", F.lit(False)), "exists").otherwise("written")
    rows = rows.withColumn("status", F.when(F.col("forced").isNotNull(), status))
    merged = rows.withColumn("close", F.when(F.col("status") == "written", F.col("_new")).otherwise(F.col("close"))).where("_had OR status = 'written'").drop("_new", "_had", "forced", "status")
    return merged, rows.where("status IS NOT NULL").select("code", "date", "status")


def log_of(spark, path: str, after: int = -1) -> DataFrame:
    """The log's rows: what the newest compaction holds, and the batches after it."""
    base = spark.read.parquet(f"{path}/base={after}").drop("base") if after >= 0 else None
    batches = spark.read.option("basePath", path).parquet(f"{path}/batch=*").where(F.col("batch") > after)
    return batches if base is None else base.unionByName(batches)


def compact(spark, path: str, upto: int, after: int = -1) -> None:
    """Writes what batches up to ``upto`` come to as base=upto, and then deletes those batches and the base before. A day
    keeps its row with the flag and batch that decide over later ones, so reading goes on as if nothing had happened."""
    newest = Window.partitionBy("code", "date").orderBy(F.col("forced").desc(), F.when(F.col("forced"), -F.col("batch")).otherwise(F.col("batch")), F.col("close").desc())
    log_of(spark, path, after).where(F.col("batch") <= upto).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/base={upto}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [f"base={after}", *(f"batch={k}" for k in range(after + 1, upto + 1))]:
        files.delete(hadoop(f"{path}/{name}"), True)
