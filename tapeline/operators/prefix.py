"""Running sums over a whole table, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import stored


def running(rows: DataFrame, order: Column, sums: dict[str, str]) -> DataFrame:
    """``rows`` with the sum of each column of ``sums`` (new name -> column) over the rows up to and with its own, by ``order``.

    Rows are dealt to ranges of ``order``, each range is summed by itself, and the totals of the ranges before it, a row a
    partition, are added. Rows of equal ``order`` are equals: each has the sum up to the last of them."""
    ranged = stored(rows.withColumn("_o", order).repartitionByRange("_o").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())])
    offsets = offsets.select("_part", *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    inside = Window.partitionBy("_part").orderBy("_o")
    out = ranged.join(offsets, "_part")
    for k, (name, c) in enumerate(sums.items()):
        out = out.withColumn(name, F.sum(c).over(inside) + F.col(f"_b{k}"))
    return out.select(*rows.columns, *sums)
