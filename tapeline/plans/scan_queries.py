"""Queries of scans and small functions over the order tables, and their SQL for another engine, written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import validation
from ..sources import scans

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Names with blanks, marks and days in them, of each order.
NAMES = "CASE o_orderkey % 6 WHEN 0 THEN ' ' || o_orderpriority || '/x ' WHEN 1 THEN '..' WHEN 2 THEN 'list_' || strftime(o_orderdate, '%Y%m%d') || '_12.html' WHEN 3 THEN 'a 1234567 b' WHEN 4 THEN 'x20261399y' ELSE o_orderstatus END"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, F.concat(F.lit(" "), "o_orderpriority", F.lit("/x "))).when(k == 1, "..").when(k == 2, F.concat(F.lit("list_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_12.html"))).when(k == 3, "a 1234567 b").when(k == 4, "x20261399y").otherwise(F.col("o_orderstatus"))
    return read(spark, sf_dir, "orders").select("*", name.alias("name"))


@query("SELECT trim(o_orderpriority) AS code, min(o_orderkey) AS place FROM orders GROUP BY trim(o_orderpriority)")
def s05_code_list(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("  "), "o_orderpriority").alias("code"), "o_orderkey")
    return scans.code_list(rows.union(rows.limit(0).select(F.lit(" "), F.lit(0).cast("long"))), F.col("o_orderkey"))


@query("SELECT substr(p_type, 1, 6) AS code, arg_min(trim(p_name), p_partkey) AS name, arg_min(p_brand, p_partkey) AS parent FROM part WHERE p_size > 3 GROUP BY substr(p_type, 1, 6)")
def s06_universe(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    rows = p.select(F.when(F.col("p_size") > 3, F.concat(F.lit(" "), "p_type")).otherwise("  ").alias("code"), "p_name", "p_brand", "p_partkey").withColumnsRenamed({"p_name": "name", "p_brand": "parent"})
    return scans.universe(rows, F.col("p_partkey"))


@query("SELECT o_orderpriority AS code, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)")
def s12_clean_bars(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"), "o_orderkey")
    return scans.clean_bars(o, F.col("o_orderkey")).drop("o_orderkey")


@query("""SELECT trim(c_name) AS code, CAST(trunc(c_acctbal) AS INTEGER) AS cluster, c_custkey % 5 IN (0, 1, 2) AS selected, c_mktsegment AS reason FROM customer WHERE c_custkey % 7 > 1""")
def s13_mapping(spark, sf_dir):
    k = F.col("c_custkey")
    said = F.element_at(F.array(*[F.lit(v) for v in (" TRUE", "1", "Yes ", "no", "")]), (k % 5).cast("int") + 1)
    rows = read(spark, sf_dir, "customer").select(F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("code"), F.when(k % 7 == 1, "x").otherwise(F.col("c_acctbal").cast("string")).alias("cluster"), said.alias("selected"), F.col("c_mktsegment").alias("reason"))
    return scans.mapping(rows).drop("name", "n")


@query("SELECT trim(o_orderstatus) AS code, min(o_orderkey) AS place FROM orders WHERE o_totalprice > 100000 GROUP BY trim(o_orderstatus)")
def s14_selected_codes(spark, sf_dir):
    return scans.code_list(read(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderstatus").alias("code"), "o_orderkey"), F.col("o_orderkey"))


@query("SELECT n_name AS code, 'k' || n_regionkey AS key FROM nation WHERE n_nationkey % 4 = 0")
def s17_listing_lookup(spark, sf_dir):
    k = F.col("n_nationkey") % 4
    rows = read(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name").alias("code"), F.when(k == 0, F.concat(F.lit("k"), F.col("n_regionkey").cast("string"))).when(k == 1, "NaN").when(k == 2, " none ").otherwise("").alias("key"))
    return scans.listing_lookup(rows)


@query("SELECT 'transition_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '_x.html' AS path, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code FROM part WHERE p_partkey % 3 > 0")
def s19_listing_files(spark, sf_dir):
    k = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    return scans.listing_files(read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("transition_"), k, F.lit("_x.html"))).otherwise(F.concat(F.lit("page_"), k)).alias("path")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN round(c_acctbal, 2) END AS dist_value, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_nationkey AS INTEGER) END AS cluster_id, c_custkey % 2 = 0 AS is_rep, c_custkey % 6 = 0 AS recommend FROM customer""")
def s22_helpers(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 3 == 0, "—").when(k % 3 == 1, F.concat(F.format_string("%.2f", "c_acctbal"), F.lit("%"))).otherwise(F.format_string(" %.2f ", "c_acctbal")).alias("dist"), F.lit("").alias("ret20"), F.when(k % 4 > 0, F.col("c_nationkey").cast("string")).otherwise("nan").alias("cluster"),
        F.when(k % 2 == 0, "yes").otherwise("").alias("rep"), F.when(k % 2 == 0, "yes").alias("recommended"), F.when(k % 3 == 0, "buy").otherwise("hold").alias("action"),
    )
    return scans.with_helpers(rows).select("c_custkey", F.round("dist_value", 2).alias("dist_value"), "cluster_id", "is_rep", "recommend")


@query("""WITH k AS (SELECT DISTINCT c_mktsegment AS code FROM customer), b AS (SELECT DISTINCT o_orderpriority AS code FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'),
s AS (SELECT o_orderpriority AS code, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE max(o_totalprice) END AS close FROM orders GROUP BY o_orderpriority)
SELECT s.code, CASE WHEN s.code LIKE '5%' THEN 'unknown' WHEN s.close IS NULL THEN 'skip' WHEN b.code IS NOT NULL AND s.code NOT LIKE '2%' THEN 'exists' ELSE 'written' END AS status FROM s LEFT JOIN b ON b.code = s.code UNION ALL SELECT code, 'missing' FROM k""")
def s04_snapshot_report(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    bars = o.select(F.col("o_orderpriority").alias("code"), F.to_date("o_orderdate").alias("date"))
    snap = o.groupBy(F.col("o_orderpriority").alias("code")).agg(F.max("o_totalprice").alias("close")).withColumn("close", F.when(~F.col("code").like("1%"), F.col("close"))).select("code", "close", *[F.lit(0.0).alias(c) for c in ("open", "high", "low", "volume")])
    codes = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("code")).union(bars.select("code").where("code NOT LIKE '5%'"))
    return scans.snapshot_report(snap, codes, bars, F.lit("1998-10-03").cast("date"), F.col("code").like("2%"))


@query("""WITH o AS (SELECT o_orderpriority AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, max(o_totalprice) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders WHERE NOT (o_orderpriority LIKE '2%' AND extract(month FROM o_orderdate) IN (4, 5)) GROUP BY 1, 2)
SELECT c.code, d.date, last_value(o.close IGNORE NULLS) OVER (PARTITION BY c.code ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS close, o.volume FROM (SELECT DISTINCT code FROM o WHERE code NOT LIKE '3%') c CROSS JOIN (SELECT DISTINCT date FROM o WHERE code NOT LIKE '3%') d LEFT JOIN o ON o.code = c.code AND o.date = d.date""")
def s08_close_volume(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("NOT (o_orderpriority LIKE '2%' AND month(o_orderdate) IN (4, 5))")
    bars = o.groupBy(F.col("o_orderpriority").alias("code"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.max("o_totalprice").alias("close"), F.count("*").cast("double").alias("volume"))
    return scans.closes_and_volumes(bars, bars.where("code NOT LIKE '3%'"), fill=True)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y%m%d') AS compact FROM orders")
def x02_day_keys(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", x.month_key(d).alias("month"), x.iso_day(d).alias("iso"), x.compact_day(d).alias("compact"))


@query(f"SELECT o_orderkey, coalesce(nullif(trim(regexp_replace(trim({NAMES}), '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), ''), 'unnamed') AS safe FROM orders")
def x03_safe_names(spark, sf_dir):
    return names(spark, sf_dir).select("o_orderkey", x.safe_name(F.col("name")).alias("safe"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def x04_day_in_name(spark, sf_dir):
    return names(spark, sf_dir).select("o_orderkey", x.day_in_name(F.col("name")).alias("day"))


@query("SELECT c_custkey, c_custkey % 5 < 3 AS yes FROM customer")
def x05_truthy(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(v) for v in (" TRUE", "1", "Yes ", "no", None)]), (F.col("c_custkey") % 5).cast("int") + 1)
    return read(spark, sf_dir, "customer").select("c_custkey", x.truthy(said).alias("yes"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN round(c_acctbal) / 37 END AS v FROM customer)
SELECT c_custkey, coalesce(printf('%.1f%%', v * 100), '—') AS pct, coalesce(printf('%+.2f%%', v * 100), '-') AS signed, coalesce(printf('%.4f', v), '—') AS price, CASE WHEN v > 10 THEN 'yes' ELSE '' END AS flag FROM c""")
def x06_formats(spark, sf_dir):
    # round() of a number between -0.5 and 0 is 0 without its sign, which formats show
    whole = F.signum("c_acctbal") * F.round(F.abs("c_acctbal"))
    v = F.when(F.col("c_custkey") % 9 > 0, whole / 37).otherwise(F.lit(float("nan")))
    rows = read(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    return rows.select("c_custkey", x.percent(F.col("v")).alias("pct"), x.percent(F.col("v"), 2, "-", signed=True).alias("signed"), x.price(F.col("v")).alias("price"), x.yes_or_blank(x.finite(F.col("v")) > 10).alias("flag"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN round(c_acctbal, 2) END AS v FROM customer")
def x07_parse_percent(spark, sf_dir):
    k = F.col("c_custkey") % 5
    n = F.format_string("%.2f", "c_acctbal")
    text = F.when(k == 0, F.concat(n, F.lit("%"))).when(k == 1, F.concat(F.lit(" "), n)).when(k == 2, "—").when(k == 3, "about")
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(x.parse_percent(text), 2).alias("v"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN CAST(trunc(c_acctbal) AS BIGINT) END AS v FROM customer")
def x08_whole(spark, sf_dir):
    k = F.col("c_custkey") % 4
    return read(spark, sf_dir, "customer").select("c_custkey", x.whole(F.when(k < 2, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).when(k == 2, "nan").otherwise("x")).alias("v"))


@query("SELECT o_orderkey, CAST(o_orderdate - INTERVAL 282 DAY AS DATE) AS start FROM orders")
def x11_window_start(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", x.window_start(F.to_date("o_orderdate"), 252).alias("start"))


@query("""WITH RECURSIVE days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT day, CAST(day AS DATE) AS dd, 7 AS togo FROM days UNION ALL
SELECT day, CAST(dd - INTERVAL 1 DAY AS DATE), togo - CASE WHEN isodow(CAST(dd - INTERVAL 1 DAY AS DATE)) < 6 THEN 1 ELSE 0 END FROM s WHERE togo > 0) SELECT day, max(dd) AS back FROM s WHERE togo = 0 GROUP BY day""")
def x10_business_days_back(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", x.business_day(F.col("day"), 7).alias("back"))


@query("SELECT c_custkey, left(sha256(concat_ws('|', c_name, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, ''), CAST(c_nationkey AS VARCHAR))), 24) AS key FROM customer")
def x12_digests(spark, sf_dir):
    seg = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", x.digest([F.col("c_name"), seg, F.col("c_nationkey")], 24).alias("key"))


@query("""SELECT o_orderkey, o_orderstatus || '&#124;' || o_orderpriority || '<br>' || '<br>' || 'x' AS cell, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || ' ' || o_orderpriority ELSE o_orderstatus END AS label FROM orders""")
def x14_markdown(spark, sf_dir):
    text = F.concat("o_orderstatus", F.lit("|"), "o_orderpriority", F.lit("\r\n\nx"))
    return read(spark, sf_dir, "orders").select("o_orderkey", x.markdown_cell(text).alias("cell"), x.code_with_name(F.concat("o_orderstatus", F.lit(" ")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("  ")).alias("label"))


REASON = "CASE c_custkey % 5 WHEN 0 THEN 'a| insufficient_history_for_clustering |' WHEN 1 THEN 'missing_from_data' WHEN 2 THEN ' | ' WHEN 3 THEN 'x|y' END"


def _reasons(spark, sf_dir):
    k = F.col("c_custkey") % 5
    return read(spark, sf_dir, "customer").select("*", F.when(k == 0, "a| insufficient_history_for_clustering |").when(k == 1, "missing_from_data").when(k == 2, " | ").when(k == 3, "x|y").alias("reason"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'insufficient_history' WHEN 1 THEN 'missing_from_data' WHEN 3 THEN 'mixed_diagnostics' ELSE 'target_count_not_selected' END AS kind FROM customer")
def x15_reason_kind(spark, sf_dir):
    from ..operators import pool

    return _reasons(spark, sf_dir).select("c_custkey", pool.reason_kind(pool.tags(F.col("reason"))).alias("kind"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split({REASON}, '|'))) AS tag FROM customer) t WHERE tag <> '' GROUP BY tag")
def o13_reason_tags(spark, sf_dir):
    from ..operators import pool

    return _reasons(spark, sf_dir).select(F.explode(pool.tags(F.col("reason"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 THEN p_name || '(' || CAST(p_partkey AS VARCHAR) || ')' ELSE p_name END AS label FROM part")
def x16_display_names(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("code"), F.concat("p_name", F.lit(" ")).alias("name"))
    return x.display_names(rows, "p_partkey").select("p_partkey", "label")


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(abs(l_extendedprice - round(l_extendedprice)) <= 0.1, false) AS absolute, coalesce(abs(l_extendedprice - round(l_extendedprice)) <= greatest(0.0, abs(round(l_extendedprice)) * 1e-6), false) AS relative FROM lineitem")
def x17_close_to(spark, sf_dir):
    p = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.close_to(p, F.round(p), 0.1).alias("absolute"), x.close_to(p, F.round(p), 0.0, 1e-6).alias("relative"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN array_to_string(list_sort(list_distinct([n_regionkey, 5, 20, 5])), ',') END AS windows FROM nation")
def o14_windows(spark, sf_dir):
    text = F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("20, 5,"), F.col("n_regionkey").cast("string"), F.lit(" ,,5"))).otherwise(" , ")
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(x.windows(text).cast("array<string>"), ",").alias("windows"))


@query("""WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS "F", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS "O", CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS "P" FROM orders GROUP BY 1)
SELECT month, status, n FROM b UNPIVOT (n FOR status IN ("F", "O", "P"))""")
def o11_pivot_unpivot(spark, sf_dir):
    wide = read(spark, sf_dir, "orders").groupBy(x.month_key(F.col("o_orderdate")).alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    return wide.unpivot(["month"], ["F", "O", "P"], "status", "n")


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderpriority, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 100 OR place > (SELECT count(*) FROM orders) - 5""")
def o02_sort_nulls_last(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    by = [F.desc_nulls_last("price"), F.asc("o_orderpriority"), F.asc("o_orderkey")]
    n = o.count()
    head = o.orderBy(*by).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*by)))
    back = [F.asc_nulls_first("price"), F.desc("o_orderpriority"), F.desc("o_orderkey")]
    tail = o.orderBy(*back).limit(5).withColumn("place", n + 1 - F.row_number().over(Window.orderBy(*back)))
    return head.unionByName(tail).select("o_orderkey", F.col("place").cast("int").alias("place"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:6], '|') AS keys, count(*) AS n FROM orders GROUP BY o_custkey")
def o12_joined_keys(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = read(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(order))
    # the list holds six at most, however many there are
    best = F.sort_array(F.collect_list(F.when(F.col("nth") <= 6, F.struct("nth", "o_orderkey"))))
    return ranked.groupBy("o_custkey").agg(F.array_join(F.transform(best, lambda s: s["o_orderkey"].cast("string")), "|").alias("keys"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderpriority AS code, o_orderdate AS d, o_orderkey AS k, o_totalprice / 1000 AS r FROM orders), f AS (SELECT code, count(*) AS n, CAST(round(arg_min(r, k) * 1e6) AS BIGINT) AS a, CAST(round(arg_max(r, k) * 1e6) AS BIGINT) AS b, sum(CAST(round(r * 1e6) AS BIGINT)) AS t FROM r GROUP BY code)
SELECT code, left(sha256(n || '|' || a || '|' || b || '|' || t), 16) AS fingerprint FROM f""")
def t04_fingerprints(spark, sf_dir):
    return scans.fingerprints(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("date"), (F.col("o_totalprice") / 1000).alias("r")))


@query("""WITH m AS (SELECT c_nationkey AS key, arg_max(c_name, c_custkey) AS model FROM customer WHERE c_nationkey % 3 > 0 GROUP BY c_nationkey) SELECT n_nationkey AS key, m.model, m.key IS NULL AS to_fit FROM nation LEFT JOIN m ON m.key = n_nationkey""")
def t04_reusable_models(spark, sf_dir):
    keys = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"))
    models = read(spark, sf_dir, "customer").where("c_nationkey % 3 > 0").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("model"), F.col("c_custkey").alias("written"))
    have, lack = scans.reusable(keys, models)
    return have.withColumn("to_fit", F.lit(False)).unionByName(lack.withColumn("to_fit", F.lit(True)), allowMissingColumns=True)


@query("""SELECT c_custkey AS code, CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'shared' WHEN c_custkey % 5 = 0 THEN 'former' END AS config, CASE WHEN c_custkey % 2 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN 2 END AS layer FROM customer""")
def t05_resolved_methods(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    return scans.resolved_methods(c, [c.where(F.col("code") % n == 0).withColumn("config", F.lit(name)) for n, name in ((2, "own"), (3, "shared"), (5, "former"))])


@query("""WITH s AS (SELECT o_custkey AS code, count(*) AS n, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY o_custkey)
SELECT code, CASE WHEN code % 5 = 0 THEN 'new' WHEN code % 5 = 1 THEN 'redraw' WHEN n - 1 = 0 THEN 'same' WHEN n - 1 = 1 THEN 'append' ELSE 'redraw' END AS change FROM s""")
def t06_changed_pages(spark, sf_dir):
    s = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code")).agg((F.count("*") - 1).alias("bars_after"), F.max_by("o_totalprice", "o_orderkey").alias("close_at_end"))
    pages = s.where("code % 5 > 0").select("code", F.lit("1998-01-01").cast("date").alias("plot_end"), F.when(F.col("code") % 5 == 1, F.col("close_at_end") * 1.001).otherwise(F.col("close_at_end") * (1 + 1e-8)).alias("close_last"))
    return scans.changed(pages, s)


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE extract(year FROM o_orderdate) <> 1996""")
def t02_pending_months(spark, sf_dir):
    months = read(spark, sf_dir, "orders").select(x.month_key(F.col("o_orderdate")).alias("month")).distinct()
    return scans.pending(months, months.where("month LIKE '1996%'"))


@query("""SELECT c_nationkey AS code, c_name AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) t WHERE k = 1 AND c_nationkey % 2 = 1 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0""")
def u09_merged_summary(spark, sf_dir):
    before = scans.first_of(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_name").alias("value"), "c_custkey"), ["code"], F.col("c_custkey")).drop("c_custkey")
    return validation.merged(before, read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("value")))
