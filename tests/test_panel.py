"""Panel queries against a second engine on the smallest tables, and the scans against hand-made cases."""

import math
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from tapeline.functions.dialect import other_sql, spark_sql
from tapeline.operators import clusters, scans
from tapeline.plans import frame_queries, pool_queries, registry, rule_queries, scan_queries, signal_queries, source_queries, views, walk_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for name in views.TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, str)):
        return x
    return float(x) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "as_tuple") else str(x)[:10]


@pytest.mark.parametrize("name", ["f01_clean_bars", "f03_resume_after_gap", "u01_upsert_bars", "g09_features", "w06_hist_percentile", "w15_band_change", "w19_band_position", "w21_mode_smoothing", "w25_forward_label", "p09_hold_up", "a02_pair_corr", "a08_quota", "x26_six_states", "j09_as_of", "t09_event_bars", "t08_sessions", *(n for part in (rule_queries, scan_queries, walk_queries, signal_queries, source_queries, frame_queries, pool_queries) for n in part.ORACLE_SQL if n != "w06_hist_percentile")])
def test_same_rows(spark, other, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(value(r[c]) for c in cols) for r in df.collect()]
    rel = other.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = [tuple(value(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    assert len(got) == len(want) and sorted(got, key=str) == sorted(want, key=str)


def test_formats_keep_the_sign_of_zero(spark, tmp_path):
    """As the SQL: what is rounded to zero from below is written with its sign."""
    rows = [(k, b) for k, b in enumerate([-0.5, -0.49, -0.3, -0.01, 0.0, 0.01, 0.29, 0.5, -0.2, -1.49, -1.5, 1.5, 999.5, -0.25, None])]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    cols = ["c_custkey", "pct", "signed", "price", "flag"]
    got = sorted(tuple(r[c] for c in cols) for r in scan_queries.QUERIES["x06_formats"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({scan_queries.ORACLE_SQL['x06_formats']})").fetchall()) and got[2][1:4] == ("-0.0%", "-0.00%", "-0.0000")


def test_dialect():
    assert spark_sql("@QUANTILE(abs(a, b), 0.5)") == "percentile(abs(a, b), 0.5)"
    assert other_sql("x @DAYS(a, lag(b) OVER (w))") == "x date_diff('day', lag(b) OVER (w), a)"


def test_hysteresis_confirms_and_leaves():
    close = [10.0] * 3 + [11.0, 12.0, 13.0] + [9.0, 9.0, 9.0]
    ma20, ma60 = [10.5] * 9, [10.6] * 9
    raw = ["range"] * 3 + ["up"] * 3 + ["down"] * 3
    assert scans.hysteresis(raw, close, ma20, ma60, 2) == ["range"] * 4 + ["up", "up", "down", "down", "down"]
    nan = [math.nan] * 9
    assert scans.hysteresis(["up"] * 9, close, nan, nan, 2) == ["range"] * 9


def test_scans_are_causal():
    rng = random.Random(3)
    close = [100.0]
    for _ in range(300):
        close.append(close[-1] * math.exp(rng.gauss(0, 0.02)))
    ma20 = [np.mean(close[max(0, i - 19) : i + 1]) for i in range(len(close))]
    ma60 = [np.mean(close[max(0, i - 59) : i + 1]) for i in range(len(close))]
    raw = [rng.choice(["up", "down", "range"]) for _ in close]
    for f in (scans.hysteresis, scans.stack_hysteresis):
        assert f(raw, close, ma20, ma60)[:200] == f(raw[:200], close[:200], ma20[:200], ma60[:200])


def test_merge_short():
    assert scans.merge_short(["up"] * 5 + ["down"] + ["up"] * 5, 3) == ["up"] * 11
    assert scans.merge_short(["down"] + ["up"] * 4, 3) == ["up"] * 5
    assert scans.merge_short(["up"], 3) == ["range"] and scans.merge_short([], 3) == []


def test_rule_machine():
    done = scans.rule_machine([10.0, 10.0, 12.0, 9.0, 9.0], [True, False, False, False, False], [False] * 5, trail=0.2)
    assert done["trades"] == [(0, 1, 4, 9.0 / 10.0 - 1, "trail")] and not done["holding"]
    last = scans.rule_machine([10.0, 11.0], [False, True], [False, False])
    assert last["action"] == "buy" and not last["holding"] and last["trades"] == []
    masked = scans.rule_machine([10.0] * 4, [True] + [False] * 3, [False, False, True, True], g1=[False, True, False, False])
    assert masked["trades"] == [] and masked["holding"]


def test_ward_and_split(spark):
    corr = np.array([[1, 0.9, 0.1, 0.1], [0.9, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.8], [0.1, 0.1, 0.8, 1.0]])
    merges = clusters.ward(1 - corr)
    assert clusters.cut(merges, 4, 0.4) == [1, 1, 2, 2] and [m[3] for m in merges] == [2, 2, 4]
    pairs = spark.createDataFrame([(x, y, float(corr["abcd".index(x), "abcd".index(y)])) for x, y in combinations("abcd", 2)], "code_a string, code_b string, corr double")
    one = spark.createDataFrame([(c, 1) for c in "abcd"] + [("z", 2)], "code string, cluster int")
    got = {r["code"]: r["split"] for r in clusters.split_by_corr(one, pairs, 0.5).collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 3, "z": 2}


def test_grouped_queries(spark):
    for name in ("p01_hysteresis", "p04_merge_short", "p12_rule_machine", "m01_ward_clusters"):
        assert registry.QUERIES[name](spark, SF).count() > 0
