"""Queries as SQL texts over the tables of a folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import spark_sql
from ..functions.features import RAILS
from ..operators.pairs import pair_table
from ..operators.rails import rails
from ..sources.adapters import BARS

#: Pairs of codes: days that both have, and their correlation, as SQL and from a DataFrame.
PAIRS = """
pairs AS (SELECT a.code AS code_a, b.code AS code_b, count(*) AS overlap, covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0) AS c FROM __P__ a JOIN __P__ b ON a.date = b.date AND a.code < b.code GROUP BY a.code, b.code),
corr AS (SELECT code_a, code_b, overlap, CASE WHEN overlap < 120 OR c IS NULL THEN CAST(0.05 AS DOUBLE) ELSE greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), c)) END AS corr FROM pairs),
both_ways AS (SELECT code_a AS code, code_b AS peer, overlap, corr FROM corr UNION ALL SELECT code_b, code_a, overlap, corr FROM corr)"""
PAIRS_GIVEN = """
corr AS (SELECT * FROM {corr}),
both_ways AS (SELECT code_a AS code, code_b AS peer, overlap, corr FROM corr UNION ALL SELECT code_b, code_a, overlap, corr FROM corr)"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_READ = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")


def view_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables of a folder. Each table that the text reads is handed to it as a DataFrame, so no view of
    the session changes; rails come from one pass over each series."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        body, given = spark_sql(text), {}
        if RAILS in text:
            given["rails"] = rails(view_query(f"WITH {BARS} SELECT * FROM bars")(spark, sf_dir))
            body = spark_sql(text.replace(RAILS, " rails AS (SELECT * FROM {rails})"))
        for source in ("panel", "recent"):
            if (pairs := PAIRS.replace("__P__", source)) in text:
                given["corr"] = pair_table(view_query(text[: text.index(pairs)].rstrip().rstrip(",") + f" SELECT code, date, ret FROM {source}")(spark, sf_dir)).where("overlap > 0")
                body = spark_sql(text.replace(pairs, PAIRS_GIVEN))
        for name in {name for _, name in _READ.findall(body)}:
            given[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spark.sql(_READ.sub(r"\1 {\2}", body), **given) if given else spark.sql(body)

    return run
