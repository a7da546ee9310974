"""Scans and sinks on odd rows and on folders."""

import json

import pytest
from pyspark.sql import functions as F

from tapeline.sources import configs, scans
from tapeline.sources.checkpoints import stored


def test_required_columns(spark):
    with pytest.raises(scans.MissingColumns, match="volume"):
        scans.require(spark.createDataFrame([], "code string, date date, open double, high double, low double, close double"), "bars")
    with pytest.raises(scans.MissingColumns):
        scans.mapping(spark.createDataFrame([], "code string"))


def test_snapshot_statuses(spark):
    snap = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("x", 3.0), ("d", 4.0)], "code string, close double").select("code", "close", *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "volume")])
    codes = spark.createDataFrame([(c,) for c in "abcde"], "code string")
    bars = spark.createDataFrame([("c", "2020-01-02"), ("d", "2020-01-02"), ("a", "2020-01-01")], "code string, date string").withColumn("date", F.to_date("date"))
    got = {r["code"]: r["status"] for r in scans.snapshot_report(snap, codes, bars, F.lit("2020-01-02").cast("date"), F.col("code") == "d").collect()}
    assert got == {"a": "written", "b": "skip", "c": "exists", "d": "written", "e": "missing", "x": "unknown"}


def test_anchor_and_lists(spark):
    rows = spark.createDataFrame([("2020-01-01", 1.0, 1), ("2020-01-01", 2.0, 2), ("2020-01-02", None, 3), (None, 5.0, 4)], "date string, close double, place int")
    assert [tuple(r) for r in scans.anchor(rows, F.col("place")).collect()] == [("2020-01-01", 2.0)] and scans.anchor(rows.limit(0), F.col("place")) is None
    assert sorted(r[0] for r in scans.stock_pool(spark.createDataFrame([(" a",), ("",), (None,), ("b ",)], "code string")).collect()) == ["a", "b"]


def test_fetch_isolates_failures(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("bad",), ("have",)], "code string")
    todo = scans.to_fetch(wanted, spark.createDataFrame([("have",)], "code string"))

    def fetch(code):
        if code == "bad":
            raise ValueError("no such code")
        return [(1, 2.0), (2, 3.0)]

    got = scans.fetch_histories(todo, fetch, "day int, close double").collect()
    assert sorted((r["code"], r["day"]) for r in got if r["error"] is None) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert [(r["code"], r["error"]) for r in got if r["error"]] == [("bad", "ValueError: no such code")] and scans.to_fetch(wanted, wanted).count() == 0 and scans.to_fetch(wanted, wanted, force=True).count() == 4


def test_config(spark):
    config = {"root": "/r", "data": "{root}/d", "bars": "{data}/b", "loop": "{loop2}", "loop2": "{loop}", "own": "{own}", "none": None}
    got = spark.createDataFrame([(config,), (None,), ({},)], "config map<string,string>").select(scans.expanded(F.col("config")).alias("x")).collect()
    assert got[0]["x"]["bars"] == "/r/d/b" and got[0]["x"]["own"] == "{own}" and got[0]["x"]["none"] is None and got[1]["x"] is None and got[2]["x"] == {}
    lines = spark.createDataFrame([('{"a": {"x": 1}, "b": {"y": "z"}, "c": 5}',), ("not json",), ("[]",), (None,), ("",)], "value string")
    assert {r["code"]: json.loads(r["config"]) for r in scans.config_map(lines).collect()} == {"a": {"x": 1}, "b": {"y": "z"}}


def test_model_cache(spark):
    r = spark.createDataFrame([("a", "2020-01-01", 0.1), ("a", "2020-01-02", 0.2), ("b", "2020-01-01", 0.1)], "code string, date string, r double")
    prints = scans.fingerprints(r)
    assert {x["code"]: x["fingerprint"] for x in prints.collect()} == {x["code"]: x["fingerprint"] for x in scans.fingerprints(r.orderBy(F.desc("date"))).collect()}
    key = scans.model_key(3, F.col("code"), F.lit("2020-01-31"), {"nu": 5, "k": 3}, F.col("fingerprint"))
    keys = [x[0] for x in prints.select(key).collect()]
    assert len(set(keys)) == 2 and all(len(k) == 24 for k in keys) and scans.config_hash({"k": 3, "nu": 5}) == scans.config_hash({"nu": 5, "k": 3})


def test_histories_and_shards(spark, tmp_path):
    bars = spark.createDataFrame([("a", "2020-01-01", 1.0), ("b", "2020-01-01", 2.0)], "code string, date string, close double").select("code", F.to_date("date").alias("date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close", "volume")])
    scans.write_histories(bars, f"{tmp_path}/bars")
    read = spark.read.parquet(f"{tmp_path}/bars")
    assert read.count() == 2 and read.where("code = 'a'").inputFiles() != read.inputFiles() or len(read.inputFiles()) == 2
    with pytest.raises(ValueError, match="no bars"):
        scans.write_histories(bars.limit(0), f"{tmp_path}/none")
    rows = spark.createDataFrame([("2020-01", 1), ("2020-02", 2)], "month string, x int")
    scans.write_shards(rows, f"{tmp_path}/shards")
    scans.write_shards(spark.createDataFrame([("2020-02", 20)], "month string, x int"), f"{tmp_path}/shards")
    now = spark.read.schema("x int, month string").parquet(f"{tmp_path}/shards")
    assert sorted((r["month"], r["x"]) for r in now.collect()) == [("2020-01", 1), ("2020-02", 20)]
    wanted = spark.createDataFrame([("2020-02",), ("2020-03",)], "month string")
    assert [r[0] for r in scans.pending(wanted, now).collect()] == ["2020-03"]


def test_pack_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("c\nd", None)], "name string, n int")
    scans.write_pack({"signals": df}, {"pass": True, "n": 2}, f"{tmp_path}/pack")
    assert spark.read.parquet(f"{tmp_path}/pack/signals").count() == 2 and json.loads(spark.read.text(f"{tmp_path}/pack/facts.json").first()[0]) == {"n": 2, "pass": True}
    assert scans.markdown(df.orderBy("n")) == "| name | n |\n| --- | --- |\n| c<br>d |  |\n| a&#124;b | 1 |" and scans.markdown(df.limit(0)) == "(none)"


def test_cluster_table(spark, tmp_path):
    folder = tmp_path / "20200102"
    folder.mkdir()
    assert scans.cluster_table(spark, str(tmp_path), "20200102") is None
    (folder / "cluster_representatives_20200102_d080.csv").write_text("code,cluster,is_representative\nab1,3,Yes\ncd2,4,0\n")
    got = scans.cluster_table(spark, str(tmp_path), "20200102").collect()
    assert [(r["code"], r["is_representative"]) for r in got] == [("AB1", True), ("CD2", False)]


def test_stored_survives_its_source(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/x")
    kept = stored(spark.read.parquet(f"{tmp_path}/x"))
    spark.range(1).write.mode("overwrite").parquet(f"{tmp_path}/x")
    assert kept.count() == 5


def test_config_caches(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "code string, config string")
    held = lambda tag="t": sorted(map(tuple, configs.read_configs(spark, str(tmp_path), tag).collect()))
    assert held() == []
    assert configs.write_configs(rows(("a", '{"x": 1}'), ("a", '{"x": 0}'), ("b", "[1]"), ("c", '{"x"'), (None, "{}"), ("d", None)), str(tmp_path), "t") == 1
    assert configs.write_configs(rows(("b", '{"y": 2}')), str(tmp_path), "t") == 2 and held() == [("a", '{"x": 0}'), ("b", '{"y": 2}')] and held("other") == []
    rows(("z", "{}")).write.parquet(f"{tmp_path}/t/version=9")
    (tmp_path / "t/version=9/_SUCCESS").unlink()  # a writer that died
    assert len(held()) == 2 and configs.write_configs(rows(("a", "{}")), str(tmp_path), "t") == 2 and held()[0] == ("a", "{}")


def test_newest_clusters(spark, tmp_path):
    for name in ("20240105/cluster_representatives_20240105.csv", "20240112/cluster_representatives_20240112_d080.csv", "20240112/notes_20240113.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"code,cluster,is_representative\na{name[:8]},1,yes\n,2,no\n")
    pick = lambda day: [tuple(r)[:3] for r in scans.newest_clusters(spark, str(tmp_path), day).collect()]
    assert pick("2024-01-11") == [("A20240105", 1, True)] and pick("2024-02-01") == [("A20240112", 1, True)]
    with pytest.raises(FileNotFoundError):
        pick("2023-12-31")
