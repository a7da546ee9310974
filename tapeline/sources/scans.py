"""Scans and sinks of the tables that a run reads and leaves: code lists, universes, mappings, summaries, shards, caches
and reports, as DataFrames over Parquet, CSV and JSON."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import day_in_name, digest, truthy, whole

REQUIRED = {"bars": ("code", "date", "open", "high", "low", "close", "volume"), "snapshot": ("code", "open", "high", "low", "close", "volume"), "mapping": ("code", "cluster", "selected", "reason")}


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, kind: str) -> DataFrame:
    """``df`` if it has the columns of its kind."""
    lacks = sorted(set(REQUIRED[kind]) - set(df.columns))
    if lacks:
        raise MissingColumns(f"{kind} lacks {lacks}")
    return df


def first_of(df: DataFrame, keys: list[str], *order: Column, last: bool = False) -> DataFrame:
    """One row for each key: the first in the order given, or the last."""
    order = tuple(c.desc() if last else c.asc() for c in order)
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def code_list(rows: DataFrame, place: Column) -> DataFrame:
    """(code, place): the codes that are left after trimming, each at its first place."""
    named = rows.select(F.trim("code").alias("code"), place.alias("place")).where("code <> ''")
    return named.groupBy("code").agg(F.min("place").alias("place"))


def universe(rows: DataFrame, place: Column) -> DataFrame:
    """(code, name, parent): the first six characters of trimmed codes, each with the names of its first place; blank codes
    go, and parents may be missing."""
    parent = F.trim("parent") if "parent" in rows.columns else F.lit(None).cast("string")
    named = rows.select(F.substring(F.trim("code"), 1, 6).alias("code"), F.trim("name").alias("name"), parent.alias("parent"), place.alias("_place")).where("code <> ''")
    return first_of(named, ["code"], F.col("_place")).drop("_place")


def stock_pool(rows: DataFrame) -> DataFrame:
    return rows.select(F.trim("code").alias("code")).where("code <> ''")


def clean_bars(bars: DataFrame, place: Column) -> DataFrame:
    """Bars for rules: of repeated days the last one counts; nothing is clipped at gaps."""
    return first_of(bars.where("code IS NOT NULL AND date IS NOT NULL"), ["code", "date"], place, last=True)


def anchor(rows: DataFrame, place: Column) -> DataFrame | None:
    """(date, close) of the anchor series, the last of repeated days; None if there is none."""
    found = first_of(rows.where("date IS NOT NULL AND close IS NOT NULL"), ["date"], place, last=True).select("date", "close")
    return None if found.isEmpty() else found


def closes_and_volumes(bars: DataFrame, codes: DataFrame, fill: bool = False) -> DataFrame:
    """(code, date, close, volume) of the codes, for each of their days; with ``fill`` a missing close takes the last one
    before it. Volumes are never filled."""
    rows = bars.join(codes.select("code").distinct(), "code", "left_semi").select("code", "date", "close", "volume")
    if not fill:
        return rows
    # a day for each code: codes are broadcast to the days only if they are few, by their size
    grid = rows.select("code").distinct().join(rows.select("date").distinct(), F.lit(True))
    before = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(rows, ["code", "date"], "left").withColumn("close", F.last("close", True).over(before))


def snapshot_report(snapshot: DataFrame, codes: DataFrame, bars: DataFrame, day: Column, force: Column | None = None) -> DataFrame:
    """(code, status) of a day's snapshot: written, exists, skip (no close) or unknown for its rows, missing for known codes
    that it lacks. ``force`` replaces what exists."""
    rows = require(snapshot, "snapshot")
    have = bars.where(F.col("date") == day).select("code", F.lit(True).alias("have")).distinct()
    known = codes.select("code", F.lit(True).alias("known")).distinct()
    status = F.when(F.col("close").isNull(), "skip").when(F.coalesce("have", F.lit(False)) & ~(force if force is not None else F.lit(False)), "exists").otherwise("written")
    seen = rows.select("code", "close", F.lit(True).alias("seen")).join(known, "code", "full").join(have, "code", "left")
    return seen.select("code", F.when(F.col("seen").isNull(), "missing").when(F.col("known").isNull(), "unknown").otherwise(status).alias("status"))


def to_fetch(wanted: DataFrame, landed: DataFrame, force: bool = False) -> DataFrame:
    """Codes whose history isn't there yet; all of them if forced."""
    return wanted.select("code").distinct() if force else wanted.select("code").distinct().join(landed.select("code"), "code", "left_anti")


def fetch_histories(codes: DataFrame, fetch: Callable[[str], list[tuple]], schema: str, attempts: int = 2) -> DataFrame:
    """Rows that ``fetch`` gives for each code, on the executors; a code that fails so often gives one row of its code and
    error. schema: of fetch's rows, without the columns code and error that come first."""

    def run(it):
        import pandas as pd

        names = ["code", "error", *(x.split()[0] for x in schema.split(", "))]
        for frame in it:
            out = []
            for code in frame.code:
                for k in range(attempts):
                    try:
                        out += [(code, None, *r) for r in fetch(code)]
                        break
                    except Exception as e:  # one code's failure is a row, not the end of the batch
                        if k == attempts - 1:
                            out.append((code, f"{type(e).__name__}: {e}", *[None] * (len(names) - 2)))
            yield pd.DataFrame(out, columns=names)

    return codes.select("code").mapInPandas(run, f"code string, error string, {schema}")


def mapping(rows: DataFrame) -> DataFrame:
    """(code, cluster, selected, reason, name, n): trimmed codes, whole clusters (rows without go), selected as yes or no."""
    require(rows, "mapping")
    extra = [F.col(c).alias(c) if c in rows.columns else F.lit(v).alias(c) for c, v in (("name", ""), ("n", None))]
    return rows.select(F.trim("code").alias("code"), whole(F.col("cluster")).cast("int").alias("cluster"), truthy(F.col("selected")).alias("selected"), "reason", *extra).where("code <> '' AND cluster IS NOT NULL")


def listing_lookup(rows: DataFrame) -> DataFrame:
    """(code, key): trimmed pairs, without blanks and the words nan and none."""
    clean = rows.select(F.trim("code").alias("code"), F.trim("key").alias("key"))
    for c in ("code", "key"):
        clean = clean.where(F.col(c).isNotNull() & ~F.lower(c).isin("", "nan", "none"))
    return clean


def listing_files(paths: DataFrame, pattern: str = r"transition_(\d{6})_") -> DataFrame:
    """(path, code) of the files (path) whose name holds a code."""
    return paths.select("path", F.regexp_extract("path", pattern, 1).alias("code")).where("code <> ''")


def cluster_table(spark: SparkSession, folder: str, day: str, suffixes: tuple[str, ...] = ("", "_d080")) -> DataFrame | None:
    """The clusters of a day (YYYYMMDD), under the first of its names that is there; None if none is, or it has no codes."""
    from pyspark.errors import AnalysisException

    for suffix in suffixes:
        try:
            found = spark.read.option("header", True).csv(f"{folder}/{day}/cluster_representatives_{day}{suffix}.csv")
        except AnalysisException:
            continue
        if "code" in found.columns and not found.isEmpty():
            found = found.withColumn("code", F.upper("code"))
            return found.withColumn("is_representative", truthy(F.col("is_representative"))) if "is_representative" in found.columns else found
    return None


def files_in(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, day) of the files that a pattern finds, with the date of eight digits in the name; nothing of them is read."""
    found = spark.read.format("binaryFile").load(pattern).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), day_in_name(name).alias("day"))


def newest_clusters(spark: SparkSession, folder: str, as_of: str, suffixes: tuple[str, ...] = ("", "_d080")) -> DataFrame:
    """The clusters (code in capitals, cluster, is_representative, day) of the newest file up to the day ``as_of``; of a day's
    files the first of the suffixes counts. Only that file is read, since its path is a filter on the scan. It is an error if
    there is none."""
    files = files_in(spark, f"{folder}/*/cluster_representatives_*.csv").withColumn("suffix", F.regexp_extract("name", r"\d{8}(.*)\.csv$", 1))
    order = F.struct("day", -F.array_position(F.array(*[F.lit(s) for s in suffixes]), F.col("suffix")), "path")
    best = files.where((F.col("day") <= F.lit(as_of).cast("date")) & F.col("suffix").isin(*suffixes)).agg(F.max(order).alias("x")).first()["x"]
    if best is None:
        raise FileNotFoundError(f"no clusters up to {as_of} in {folder}")
    rows = spark.read.option("header", True).schema("code string, cluster int, is_representative string").csv(best["path"])
    return rows.select(F.upper("code").alias("code"), "cluster", truthy(F.col("is_representative")).alias("is_representative"), F.lit(best["day"]).alias("day")).where("code IS NOT NULL")


def last_days(shards: DataFrame, day: str = "date") -> DataFrame:
    """(month, last) of a table by month: one column is read."""
    return shards.groupBy("month").agg(F.max(F.col(day).cast("date")).alias("last"))


def expanded(config: Column, rounds: int = 8) -> Column:
    """A map of texts whose values have {key} replaced by the value of that key, so many times over; a key's own name in its
    value stays. Keys that name each other in a ring change places until the rounds are over; null stays null."""
    put = lambda m: F.transform_values(m, lambda k, v: F.aggregate(F.map_entries(m), v, lambda t, e: F.when(e["key"] == k, t).otherwise(F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), config, lambda m, _: put(m))


def config_map(lines: DataFrame) -> DataFrame:
    """(code, config) from lines of JSON (value): an object of objects each; what can't be read, or isn't one, gives none."""
    parsed = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    return lines.select(F.explode(parsed).alias("code", "config")).where("code <> '_corrupt_record' AND config LIKE '{%'")


def with_helpers(checklist: DataFrame) -> DataFrame:
    """A checklist read back as text, with the numbers and flags that its columns show."""
    from ..functions.scalars import parse_percent

    out = checklist.withColumn("dist_value", parse_percent(F.col("dist"))).withColumn("ret20_value", parse_percent(F.col("ret20"))).withColumn("cluster_id", whole(F.col("cluster")).cast("int"))
    return out.withColumn("is_rep", F.coalesce(F.trim("rep") == "yes", F.lit(False))).withColumn("recommend", F.coalesce((F.trim("recommended") == "yes") & (F.col("action") == "buy"), F.lit(False)))


def model_key(schema: int, code: Column, train_end: Column, config: dict, fingerprint: Column) -> Column:
    """What makes a fitted model reusable: 24 digits over the schema, code, end of training, config and data."""
    return digest([F.lit(schema), code, train_end, F.lit(config_hash(config)), fingerprint], 24)


def config_hash(config: dict) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def fingerprints(returns: DataFrame) -> DataFrame:
    """(code, fingerprint): 16 digits over the number, the first, the last and the sum of a series' values in whole
    millionths, which don't depend on the order of the rows."""
    millionth = lambda c: F.round(c * 1e6).cast("long")
    agg = returns.groupBy("code").agg(F.count("r").alias("n"), millionth(F.min_by("r", "date")).alias("first"), millionth(F.max_by("r", "date")).alias("last"), F.sum(millionth(F.col("r"))).alias("total"))
    return agg.select("code", digest([F.col(c) for c in ("n", "first", "last", "total")], 16).alias("fingerprint"))


def reusable(keys: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(models of the keys that are there, keys that must be fitted); of a key written twice the last one counts."""
    have = first_of(models, ["key"], F.col("written"), last=True)
    return keys.join(have.drop("written"), "key"), keys.join(have.select("key"), "key", "left_anti")


def write_histories(bars: DataFrame, path: str) -> None:
    """A partition for each code; an error without the columns of bars or without rows."""
    if require(bars, "bars").isEmpty():
        raise ValueError("no bars")
    bars.repartition("code").write.mode("overwrite").partitionBy("code").parquet(path)


def write_shards(rows: DataFrame, path: str, month: str = "month") -> None:
    """Replaces the months that ``rows`` has and leaves all others; readers never see half a month."""
    rows.repartition(month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def pending(wanted: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """The shards, or days of shards, that aren't done."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_pack(tables: dict[str, DataFrame], facts: dict, path: str) -> None:
    """A folder for each table and facts.json, one line of text, beside them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts.json")


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table as Markdown, for a report: of more than so many rows the first by all columns, and a line that says so."""
    from ..functions.scalars import markdown_cell

    head = "| " + " | ".join(rows.columns) + " |\n| " + " | ".join("---" for _ in rows.columns) + " |"
    cells = rows.select(*[F.coalesce(markdown_cell(F.col(c)), F.lit("")).alias(c) for c in rows.columns])
    total = cells.count()
    if total > most:
        cells = cells.orderBy(*cells.columns).limit(most)
    body = [r[0] for r in cells.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells.columns), F.lit(" |"))).collect()]
    return "\n".join([head, *body, *([f"\n(the first {most} of {total} rows)"] if total > most else [])]) if body else "(none)"


def resolved_methods(wanted: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """(code, config, layer): each code's config from the first of the layers (code, config) that has one, null where none
    does; layers are in order of trust, as own, shared and former days'."""
    out = wanted.select("code").distinct().withColumn("config", F.lit(None).cast("string")).withColumn("layer", F.lit(None).cast("int"))
    for k, layer in enumerate(layers):
        have = layer.groupBy("code").agg(F.min("config").alias("_config"))
        out = out.join(have, "code", "left").select("code", F.coalesce("config", "_config").alias("config"), F.coalesce("layer", F.when(F.col("_config").isNotNull(), k)).alias("layer"))
    return out


def changed(pages: DataFrame, series: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(code, change) of pages (code, plot_end, close_last) against series (code, date_end, close_end): new, same, append
    (one later bar) or redraw. series: also bars_after, the bars after the page's end."""
    near = F.abs(F.col("close_last") - F.col("close_at_end")) <= F.greatest(F.abs("close_at_end") * tolerance, F.lit(1e-12))
    rows = series.join(pages, "code", "left")
    kind = F.when(F.col("plot_end").isNull(), "new").when(~F.coalesce(near, F.lit(False)), "redraw").when(F.col("bars_after") == 0, "same").when(F.col("bars_after") == 1, "append").otherwise("redraw")
    return rows.select("code", kind.alias("change"))
