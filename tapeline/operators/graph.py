"""Connected components and greedy choices on a table of edges, in rounds of joins and partial aggregates.

No group of all nodes, and no list of them on the driver: each round reads the rows that are still open from the shared
folder, and only their number comes back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import stored


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of nodes (id) under edges (a, b): the smallest id that can be reached. Ends that are no nodes join
    nothing. A round takes the smallest name among the neighbours and then, twice, the name of the name, so a chain of n
    takes some log n rounds."""
    known = nodes.select("id").distinct()
    ways = stored(both_ways(edges).join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi"))
    names = stored(known.withColumn("name", F.col("id")))
    while True:
        near = ways.join(names.toDF("b", "near"), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        now = names.join(near, "id", "left").select("id", F.least("name", "near").alias("name"), F.col("name").alias("old"))
        # what a node was called is told the smaller name as well
        told = now.groupBy(F.col("old").alias("id")).agg(F.min("name").alias("told"))
        now = stored(now.join(told, "id", "left").select("id", F.least("name", "told").alias("name"), "old"))
        for _ in range(2):
            up = now.select(F.col("id").alias("name"), F.col("name").alias("up"))
            now = now.join(up, "name").select("id", F.least("name", "up").alias("name"), "old")
        now = stored(now)
        if now.where("name <> old").isEmpty():
            return now.select("id", F.col("name").alias("component"))
        names = now.select("id", "name")


def first_fit(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The nodes (id, place, cluster, spare) that a walk by ``place`` keeps: those in conflict with none kept before and, if
    they are spare, in whose cluster none is kept before. Places are unique; conflicts (a, b) count both ways.

    In each round a node is kept if nothing before it that could stand against it is open: no neighbour and, if it is spare,
    no node of its cluster. Neighbours of what is kept, and spare nodes of its clusters, are out. The first open node is
    kept in any case, so the rounds end, and in an order without long chains of neighbours they are few."""
    open_ = stored(nodes.select("id", "place", "cluster", "spare"))
    ways = stored(both_ways(conflicts).join(open_.select(F.col("id").alias("a"), F.col("place").alias("pa")), "a").join(open_.select(F.col("id").alias("b"), F.col("place").alias("pb")), "b"))
    kept = []
    while not open_.isEmpty():
        waits = ways.where("pb < pa").select(F.col("a").alias("id")).distinct()
        lead = open_.groupBy("cluster").agg(F.min("place").alias("lead"))
        free = open_.join(waits, "id", "left_anti").join(lead, "cluster").where("NOT spare OR place = lead").select(open_.columns)
        free = stored(free)
        kept.append(free)
        beaten = ways.join(free.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        had = free.select("cluster").distinct().withColumn("had", F.lit(True))
        left = open_.join(free.select("id"), "id", "left_anti").join(beaten, "id", "left_anti").join(had, "cluster", "left").where("NOT spare OR had IS NULL")
        open_ = stored(left.select(open_.columns))
        ways = stored(ways.join(open_.select(F.col("id").alias("a")), "a", "left_semi").join(open_.select(F.col("id").alias("b")), "b", "left_semi"))
    out = kept[0] if kept else open_
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def farthest_first(nodes: DataFrame, weights: DataFrame, target: int, limit: float) -> DataFrame:
    """(id, nth) of at most ``target`` nodes (id, mean): always the one whose largest weight (a, b, w) with those taken is
    least, then of the highest mean, then the first, while that weight is within the limit. Without a target, or with no
    more nodes than it, all of them, by id."""
    rows = nodes.groupBy("id").agg(F.max("mean").alias("mean"))
    if target <= 0 or rows.count() <= target:
        return rows.select("id", F.row_number().over(Window.orderBy("id")).alias("nth"))
    ways = stored(weights.select("a", "b", "w").union(weights.select("b", "a", "w")).where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w")))
    rows = stored(rows.select("id", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.lit(0.0).alias("most"), F.lit(None).cast("int").alias("nth")))
    for nth in range(1, target + 1):
        best = rows.where("nth IS NULL").agg(F.min(F.struct("most", (-F.col("mean")).alias("m"), "id")).alias("x")).first()["x"]
        if best["most"] > limit:
            break
        own = ways.where(F.col("b") == F.lit(best["id"])).select(F.col("a").alias("id"), "w")
        rows = stored(rows.join(own, "id", "left").select("id", "mean", F.greatest("most", F.coalesce("w", F.lit(0.0))).alias("most"), F.when(F.col("id") == F.lit(best["id"]), nth).otherwise(F.col("nth")).alias("nth")))
    return rows.where("nth IS NOT NULL").select("id", "nth")
