"""Caches of configs by code: a folder a tag, a version a write. The newest version that was written to its end counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "code string, config string"


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop(path)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(hadoop(path))]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(hadoop(f"{path}/{n}/_SUCCESS")))


def read_configs(spark: SparkSession, cache: str, tag: str) -> DataFrame:
    """(code, config) of a tag; no rows if nothing was written."""
    found = _versions(spark, f"{cache}/{tag}")
    return spark.read.schema(SCHEMA).parquet(f"{cache}/{tag}/version={found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def write_configs(configs: DataFrame, cache: str, tag: str) -> int:
    """Adds (code, config) to a tag and returns how many codes it has then. A code that is there gets the new config; of a code
    given twice the smallest counts. What isn't an object of JSON, and rows without code, aren't written."""
    spark = configs.sparkSession
    new = configs.where("code IS NOT NULL AND try_parse_json(config) IS NOT NULL AND trim(config) LIKE '{%'").groupBy("code").agg(F.min("config").alias("config"))
    before = read_configs(spark, cache, tag)
    number = max(_versions(spark, f"{cache}/{tag}"), default=0) + 1
    before.join(new.select("code"), "code", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{cache}/{tag}/version={number}")
    return read_configs(spark, cache, tag).count()
