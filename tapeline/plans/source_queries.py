"""Queries of the history source, read once and as a stream, with the table of events as what is fetched from; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import configs, history, scans
from ..sources.adapters import BARS
from ..sources.checkpoints import folder
from ..sources.ledger import BarTable
from .rule_queries import bars

PRICES = ("open", "high", "low", "close")


def source(spark: SparkSession, reader, sf_dir: str, more: str = "", **options: str):
    """All event types are codes."""
    spark.dataSource.register(history.HistorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    types = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().orderBy("event_type").collect()  # of the catalogue
    codes = ",".join([r[0] for r in types] + more.split())
    return reader.format("history").options(codes=codes, fetch="tapeline.sources.history:event_days", path=f"{sf_dir}/events.parquet", wait="0.05", **options)


def shown(bars: DataFrame) -> DataFrame:
    return bars.select("code", "date", *[F.round(c, 6).alias(c) for c in PRICES], "volume")


def s01_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of all codes, one of which can't be fetched."""
    return shown(history.landed(source(spark, spark.read, sf_dir, "nowhere").load())[0])


def s02_pushed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between two dates of codes by name: only these are fetched."""
    rows = source(spark, spark.read, sf_dir).load()
    first = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts").cast("date").alias("d")).first()["d"]
    return shown(rows.where(F.col("code").isin("click", "view", "purchase") & (F.col("date") > F.date_add(F.lit(first), 3)) & (F.col("date") <= F.date_add(F.lit(first), 20))))


def s03_landing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, attempts and whether it failed, for each code."""
    return history.landed(source(spark, spark.read, sf_dir, "nowhere").load())[1].select("code", "days", "attempts", F.col("error").isNotNull().alias("failed"))


def s01_history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same days landed by a stream that runs twice: up to the middle, and from where it stopped to the end."""
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b")).first()
    at = folder(spark)
    for until in (last["a"] + (last["b"] - last["a"]) / 2, last["b"], last["b"]):
        rows = source(spark, spark.readStream, sf_dir, until=until.isoformat()).load()
        rows.writeStream.format("parquet").option("path", f"{at}/days").option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    return shown(spark.read.schema(history.SCHEMA).parquet(f"{at}/days"))


def landed_in_parts(spark: SparkSession, sf_dir: str) -> tuple[BarTable, DataFrame]:
    """A table of bars by commits: most days, then late ones and bars of days that are there, then forced ones."""
    table = BarTable(spark, folder(spark))
    rows = bars(spark, sf_dir).select("code", "date", F.round("close", 9).alias("close"), F.lit(False).alias("forced"))
    day = F.dayofmonth("date")
    table.merge(rows.where(day % 4 > 0))
    table.merge(rows.where(day % 2 == 0).withColumn("close", F.when(day % 10 != 0, F.col("close") + 1)))
    table.merge(rows.where((day == 9) & (F.month("date") == 3)).withColumns({"close": F.col("close") * 2, "forced": F.lit(True)}))
    return table, rows


def u06_table_of_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed_in_parts(spark, sf_dir)[0].read().select("code", "date", F.round("close", 6).alias("close"))


def t02_resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to land of the calendar after a run that stopped in the middle of a month, some months missing."""
    rows = bars(spark, sf_dir).select("code", "date", "close", F.lit(False).alias("forced"))
    table = BarTable(spark, folder(spark))
    table.merge(rows.where("date <= DATE'1997-05-13' AND month(date) <> 2"))
    return table.pending(rows)


def t01_followed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files of bars, merged batch by batch, stopped and started again."""
    at, rows = folder(spark), bars(spark, sf_dir).select("code", "date", F.round("close", 9).alias("close"), (F.dayofmonth("date") == 1).alias("forced"))
    table = BarTable(spark, f"{at}/table")

    def run() -> None:
        given = spark.readStream.schema("code string, date date, close double, forced boolean").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        table.follow(given, "bars", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()

    for part in (rows.where("year(date) < 1997"), rows.where("year(date) >= 1996").withColumn("close", F.col("close") + 1)):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
        run()
    run()
    return table.read().select("code", "date", F.round("close", 6).alias("close"))


def s15_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of each nation that name one another, in no order."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    config = F.create_map(F.lit("file"), F.lit("{day}/{name}.parquet"), F.lit("name"), F.lower("n_name"), F.lit("day"), F.concat(F.lit("{root}/"), F.col("n_regionkey")), F.lit("root"), F.concat(F.lit("/data/{name}-"), F.col("n_nationkey")), F.lit("own"), F.lit("{own} {nobody}"))
    return nations.select("n_nationkey", F.explode(scans.expanded(config)).alias("key", "value"))


def s16_config_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs of lines of which some are cut, empty, or no objects."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.lit('{"'), F.col("event_type"), F.lit('": '), F.col("props"), F.lit(', "other": '), F.when(F.col("event_id") % 2 == 0, "{}").otherwise("7"), F.lit("}"))
    broken = F.when(F.col("event_id") % 7 == 0, F.expr("left(line, length(line) - 3)")).when(F.col("event_id") % 11 == 0, "[1, 2]").when(F.col("event_id") % 13 == 0, "").otherwise(F.col("line"))
    found = scans.config_map(e.withColumn("line", line).select(broken.alias("value")))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.get_json_object("config", "$.k").cast("long")).alias("total"))


def s18_newest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of clusters of four days, of which the newest up to a day counts."""
    at, part = folder(spark), spark.read.parquet(f"{sf_dir}/part.parquet")
    codes = part.select(F.lower("p_brand").alias("code")).distinct().withColumn("number", F.regexp_extract("code", r"(\d+)$", 1).cast("int"))
    for k, (day, suffix) in enumerate((("20240105", ""), ("20240112", "_d080"), ("20240112", ""), ("20240112", "_other"), ("20240119", ""))):
        rows = codes.select("code", (F.col("number") % (k + 2)).alias("cluster"), F.when(F.col("number") % 3 == 0, "Yes").when(F.col("number") % 3 == 1, "1").alias("is_representative"))
        rows.coalesce(1).write.option("header", True).csv(f"{at}/written/{k}")
        renamed(spark, f"{at}/written/{k}", f"{at}/days/{day}/cluster_representatives_{day}{suffix}.csv")
    return scans.newest_clusters(spark, f"{at}/days", "2024-01-15")


def renamed(spark: SparkSession, written: str, name: str) -> None:
    """The one file that Spark has written gets its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(name).getParent())
    part = next(s.getPath() for s in files.listStatus(path(written)) if s.getPath().getName().startswith("part-"))
    files.rename(part, path(name))


def s20_scored_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the shards of each month reach its last day in the calendar; some were cut short."""
    at, rows = folder(spark), bars(spark, sf_dir).withColumn("month", F.date_format("date", "yyyy-MM"))
    scans.write_shards(rows.where("NOT (month(date) = 4 AND day(date) > 20)"), f"{at}/shards")
    last = scans.last_days(spark.read.parquet(f"{at}/shards")).withColumnRenamed("last", "reached")
    return scans.last_days(rows).join(last, "month", "left").select("month", "reached", F.coalesce(F.col("reached") >= F.col("last"), F.lit(False)).alias("scored"))


def u10_config_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs of customers from a run's own cache, which is written twice, or else from the shared one; some are bad."""
    at = folder(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("code"), F.col("c_custkey").alias("k"))
    config = lambda word: F.concat(F.lit(f'{{"{word}": '), F.col("k"), F.when(F.col("k") % 5 > 0, "}").otherwise(""))
    configs.write_configs(c.where("k % 2 = 0").select("code", config("first").alias("config")), f"{at}/own", "tag")
    configs.write_configs(c.where("k % 6 = 0").select("code", config("second").alias("config")), f"{at}/own", "tag")
    configs.write_configs(c.where("k % 3 = 0").select("code", config("shared").alias("config")), f"{at}/shared", "tag")
    return scans.resolved_methods(c, [configs.read_configs(spark, f"{at}/own", "tag"), configs.read_configs(spark, f"{at}/shared", "tag")])


QUERIES = {f.__name__: f for f in (s01_histories, s02_pushed_days, s03_landing_report, s01_history_stream, u06_table_of_commits, t02_resume_points, t01_followed_stream, s15_expanded, s16_config_map, s18_newest_clusters, s20_scored_months, u10_config_caches)}

_DAYS = """SELECT event_type AS code, CAST(ts AS DATE) AS date, round(first(value ORDER BY ts, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(last(value ORDER BY ts, event_id), 6) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events {where} GROUP BY 1, 2"""
ORACLE_SQL = {
    "s01_histories": _DAYS.format(where=""),
    "s01_history_stream": _DAYS.format(where=""),
    "s02_pushed_days": _DAYS.format(where="WHERE event_type IN ('click', 'view', 'purchase') AND CAST(ts AS DATE) > (SELECT CAST(min(ts) AS DATE) FROM events) + 3 AND CAST(ts AS DATE) <= (SELECT CAST(min(ts) AS DATE) FROM events) + 20"),
    "u06_table_of_commits": f"""WITH {BARS}, x AS (SELECT code, date, round(close, 9) AS close, extract(day FROM date) AS d, extract(month FROM date) AS m FROM bars)
SELECT code, date, round(CASE WHEN d = 9 AND m = 3 THEN close * 2 WHEN d % 4 = 0 THEN close + 1 ELSE close END, 6) AS close FROM x WHERE d % 4 > 0 OR (d % 2 = 0 AND d % 10 <> 0)""",
    "t02_resume_points": f"""WITH {BARS}, cd AS (SELECT DISTINCT date, strftime(date, '%Y-%m') AS month FROM bars), l AS (SELECT month, max(date) AS last FROM cd WHERE date <= DATE '1997-05-13' AND extract(month FROM date) <> 2 GROUP BY month)
SELECT c.month, min(c.date) AS first, count(*) AS days FROM cd c LEFT JOIN l ON l.month = c.month WHERE l.month IS NULL OR (l.month = (SELECT max(month) FROM l) AND c.date > l.last) GROUP BY c.month""",
    "t01_followed_stream": f"""WITH {BARS} SELECT code, date, round(round(close, 9) + CASE WHEN extract(year FROM date) >= 1997 OR (extract(year FROM date) = 1996 AND extract(day FROM date) = 1) THEN 1 ELSE 0 END, 6) AS close FROM bars""",
    "s15_expanded": """WITH n AS (SELECT n_nationkey, lower(n_name) AS name, '/data/' || lower(n_name) || '-' || n_nationkey AS root, n_regionkey FROM nation)
SELECT n_nationkey, unnest(['file', 'name', 'day', 'root', 'own']) AS key, unnest([root || '/' || n_regionkey || '/' || name || '.parquet', name, root || '/' || n_regionkey, root, '{own} {nobody}']) AS value FROM n""",
    "s16_config_map": """WITH l AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0)
SELECT event_type AS code, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM l GROUP BY 1 UNION ALL SELECT 'other', count(*), NULL FROM l WHERE event_id % 2 = 0""",
    "s18_newest_clusters": "SELECT upper(code) AS code, CAST(number % 4 AS INTEGER) AS cluster, number % 3 < 2 AS is_representative, DATE '2024-01-12' AS day FROM (SELECT DISTINCT p_brand AS code, CAST(substr(p_brand, 7) AS INTEGER) AS number FROM part) x",
    "s20_scored_months": f"""WITH {BARS} SELECT strftime(date, '%Y-%m') AS month, max(date) FILTER (WHERE extract(month FROM date) <> 4 OR extract(day FROM date) <= 20) AS reached, coalesce(max(date) FILTER (WHERE extract(month FROM date) <> 4 OR extract(day FROM date) <= 20) >= max(date), false) AS scored FROM bars GROUP BY 1""",
    "u10_config_caches": """SELECT CAST(c_custkey AS VARCHAR) AS code, CASE WHEN good AND c_custkey % 6 = 0 THEN '{"second": ' || c_custkey || '}' WHEN good AND c_custkey % 2 = 0 THEN '{"first": ' || c_custkey || '}' WHEN good AND c_custkey % 3 = 0 THEN '{"shared": ' || c_custkey || '}' END AS config,
  CASE WHEN good AND c_custkey % 2 = 0 THEN 0 WHEN good AND c_custkey % 3 = 0 THEN 1 END AS layer FROM (SELECT *, c_custkey % 5 > 0 AS good FROM customer) x""",
    "s03_landing_report": "SELECT event_type AS code, count(DISTINCT CAST(ts AS DATE)) AS days, 1 AS attempts, false AS failed FROM events GROUP BY event_type UNION ALL SELECT 'nowhere', 0, 3, true",
}
