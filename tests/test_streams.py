"""State carried along streams, and the log of upserts."""

import datetime

import numpy as np
import pandas as pd

from tapeline.operators import hmm
from tapeline.streaming import bars
from tapeline.streaming.filter import filtered_stream


def test_filter_carries_its_state(spark, tmp_path):
    rng = np.random.default_rng(0)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(30)]
    m = hmm.Model(np.ones(3) / 3, np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.2, 0.1, 0.7]]), np.array([0.0, -0.01, 0.01]), np.array([0.01, 0.02, 0.03]), reliable=True)
    models = spark.createDataFrame([(c, m.start.tolist(), m.trans.ravel().tolist(), m.mu.tolist(), m.sigma.tolist()) for c in "ab"], "code string, start array<double>, trans array<double>, mu array<double>, sigma array<double>")
    r = {c: rng.normal(0, 0.02, 30) for c in "ab"}
    schema = "code string, date date, r double"
    parts = [range(0, 10), range(10, 20), range(12, 18), range(20, 30)]  # the third comes late and is left out
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k, part in enumerate(parts):
        spark.createDataFrame(pd.DataFrame([(c, days[i], float(r[c][i])) for i in part for c in "ab"], columns=["code", "date", "r"]), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = filtered_stream(stream, models).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    assert len(got) == 60
    for c in "ab":
        mine = got[got.code == c].sort_values("date")
        assert np.allclose(mine[list(hmm.NAMES)].to_numpy(), hmm.filtered(r[c], m), atol=1e-9)


def test_upsert(spark):
    day = datetime.date(2020, 1, 1)
    old = spark.createDataFrame([("a", day, 1.0), ("b", day, 2.0), ("c", day, 3.0)], "code string, date date, close double")
    new = spark.createDataFrame([("a", day, 9.0, False), ("b", day, 8.0, True), ("b", day, 7.0, False), ("c", day, None, True), ("d", day, 4.0, False), ("e", day, None, False)], "code string, date date, close double, forced boolean")
    merged, status = bars.upsert(old, new)
    assert {r["code"]: r["close"] for r in merged.collect()} == {"a": 1.0, "b": 8.0, "c": 3.0, "d": 4.0}
    assert {r["code"]: r["status"] for r in status.collect()} == {"a": "exists", "b": "written", "c": "skip", "d": "written", "e": "skip"}
    again, status = bars.upsert(merged, new.where("NOT forced"))
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect())) and bars.upsert(old.limit(0), new.limit(0))[0].count() == 0


def test_compaction_changes_nothing(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    batches = [[("a", day, 1.0, False), ("b", day, 1.0, True)], [("a", day, 2.0, True), ("b", day, 2.0, False), ("c", day, 2.0, False)], [("a", day, 3.0, True), ("c", day, 3.0, False), ("d", day, 3.0, False)]]
    path = f"{tmp_path}/log"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "code string, date date, close double, forced boolean").write.parquet(f"{path}/batch={k}")
    whole = {r["code"]: r["close"] for r in bars.current(bars.log_of(spark, path)).collect()}
    assert whole == {"a": 3.0, "b": 1.0, "c": 2.0, "d": 3.0}
    bars.compact(spark, path, 1)
    assert {r["code"]: r["close"] for r in bars.current(bars.log_of(spark, path, 1)).collect()} == whole
    bars.compact(spark, path, 2, 1)
    spark.createDataFrame([("b", day, 5.0, False), ("e", day, 5.0, False)], "code string, date date, close double, forced boolean").write.parquet(f"{path}/batch=3")
    assert {r["code"]: r["close"] for r in bars.current(bars.log_of(spark, path, 2)).collect()} == whole | {"e": 5.0}
