"""Segmentation methods, the choice between them, the hidden states and the streams."""

import shutil

import numpy as np
import pandas as pd
import pytest

from tapeline.operators import hmm, methods
from tapeline.plans import registry
from tapeline.streaming import bars

SF = "/root/testdata/sf0.001"


def test_truth_of_one_swing():
    close = np.concatenate([np.linspace(100, 160, 100), np.linspace(160, 90, 100)])
    got = methods.truth(close)
    assert got[50] == "up" and got[150] == "down" and set(got) == {"up", "down"}
    assert set(methods.truth(close[:59])) == {"range"} and set(methods.truth(np.full(80, 5.0))) == {"range"}


def test_grid_and_mode():
    sizes = {m: len(methods.grid(m)) for m in methods.METHODS}
    assert sizes == {"ma_stack_hyst": 9, "ma_stack_struct": 9, "ma_stack_strict": 25, "dual_ma_cross": 9, "adx_di": 9, "prior60_band": 3, "hybrid_ma_adx": 9}
    raw = ["up", "range", "down", "down", "up", "up"]
    want = [min(set(w := raw[max(0, i - 2) : i + 1]), key=lambda x: (-w.count(x), x)) for i in range(len(raw))]
    assert list(methods.mode(raw, 3)) == want and len(methods.mode([], 3)) == 0


def test_trades_and_score():
    label, close = np.array(["range", "up", "up", "down", "up"], dtype=object), np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    assert methods.trades(label, close) == [(2.0, False), (1.0, True)]
    assert methods.score(label, close, label) == pytest.approx(0.45 + 0.25 + 0.15 * 0.6 - 0.015 * 3)


def test_hidden_states():
    rng = np.random.default_rng(3)
    r = np.concatenate([rng.normal(0.0002, 0.004, 200), rng.normal(-0.001, 0.02, 200)])
    m = hmm.fit(r, k=2)
    assert m.reliable and m.sigma[1] / m.sigma[0] > 2 and np.allclose(m.trans.sum(1), 1)
    w = hmm.filtered(r, m)
    assert np.allclose(w.sum(1), 1) and w[50:180, 0].mean() > 0.7 and w[250:, 1].mean() > 0.7
    assert np.allclose(hmm.filtered(r[:100], m), w[:100]) and not hmm.fit(r[:59]).reliable
    weight, moves, total = hmm.posteriors(r[:6], m, 5.0)
    # against all paths
    import itertools

    dense, paths = np.exp(hmm.log_density(r[:6], m, 5.0)), {}
    for path in itertools.product(range(2), repeat=6):
        p = m.start[path[0]] * dense[0, path[0]]
        for t in range(1, 6):
            p *= m.trans[path[t - 1], path[t]] * dense[t, path[t]]
        paths[path] = p
    assert total == pytest.approx(np.log(sum(paths.values())))
    assert weight[3, 1] == pytest.approx(sum(p for k, p in paths.items() if k[3] == 1) / sum(paths.values()))


def test_series_queries(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert n
    final = registry.QUERIES["g07_method_labels"](spark, SF).toPandas()
    assert set(np.unique(final[list(methods.METHODS)].to_numpy())) <= {"up", "down", "range"}
    strict = registry._series(spark, SF).toPandas().sort_values(["code", "date"])
    native = registry.view_query(registry.SQL["g03_raw_labels"])(spark, SF).toPandas().sort_values(["code", "date"])
    assert list(methods.strict_raw(strict, 0.06, 0.06)) == list(native["label"])
    for name in ("p06_truth", "g11_method_choice", "g13_out_of_sample", "m09_hidden_states", "p17_filtered_states"):
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in")
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = bars.event_bars(stream).writeStream.outputMode("complete").format("memory").queryName("streamed_bars").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("streamed_bars").collect()) == sorted(bars.event_bars(table).collect())


def test_upsert_log(spark, tmp_path):
    schema = "code string, date string, close double, forced boolean"
    for k, rows in enumerate([[("a", "2024-01-02", 1.0, False), ("a", "2024-01-03", None, False)], [("a", "2024-01-02", 2.0, False), ("b", "2024-01-02", 5.0, False)], [("b", "2024-01-02", 6.0, True)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        bars.append_log(stream, str(tmp_path / "log"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = bars.current(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert sorted(tuple(r) for r in got) == [("a", "2024-01-02", 1.0), ("b", "2024-01-02", 6.0)]


def test_labels_of_an_empty_series():
    s = pd.DataFrame({c.strip(): [] for c in methods.COLUMNS.split(",")})
    assert len(methods.mode(list(s.g1_raw), 3)) == 0
