"""The history source: retries, failures, pushed filters, and streams that go on where they stopped."""

import datetime

import pytest

from tapeline.sources import history


@pytest.fixture(scope="module")
def read(spark):
    spark.dataSource.register(history.HistorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def options(reader, codes, fetch="days", **more):
        return reader.format("history").options(codes=codes, fetch=f"tests.fetchers:{fetch}", wait="0.01", **more).load()

    return options


def test_failures_are_rows(spark, read):
    bars, report = history.landed(read(spark.read, "a, bad,flaky,empty,a"))
    got = {r["code"]: (r["days"], r["attempts"], r["error"]) for r in report.collect()}
    assert got == {"a": (10, 1, None), "flaky": (10, 3, None), "bad": (0, 3, "OSError: no answer")}  # empty has no day and no error
    assert bars.count() == 20 and "error" not in bars.columns
    with pytest.raises(RuntimeError, match="none of 1 histories came: OSError"):
        history.landed(read(spark.read, "bad"))
    assert history.landed(read(spark.read, "empty"))[0].count() == 0 and history.landed(read(spark.read, ""))[1].count() == 0


def test_filters_reach_the_provider(spark, read):
    d = datetime.date
    day = lambda r: (r["code"], r["date"], d.fromordinal(int(r["close"])))
    rows = read(spark.read, "a,b,c", "wide")
    assert [day(r) for r in rows.where("code = 'b' AND date >= DATE'2024-02-01' AND date < DATE'2024-03-01'").collect()] == [("b", d(2024, 2, 1), d(2024, 2, 29))]
    assert sorted(day(r) for r in rows.where("code IN ('a', 'c') AND date > DATE'2024-02-01'").collect()) == [(c, d(2024, 2, 2), d(2100, 1, 1)) for c in "ac"]
    assert [day(r) for r in rows.where("code = 'c' AND date = DATE'2024-02-05'").collect()] == [("c", d(2024, 2, 5), d(2024, 2, 5))]
    assert read(spark.read, "a,b,c", "wide").count() == 3 and rows.where("code = 'x'").count() == 0 and rows.where("code = 'a' AND volume > 1").count() == 0


def test_streams_go_on_where_they_stopped(spark, read, tmp_path):
    down = tmp_path / "down"

    def land(until):
        rows = read(spark.readStream, "a,b", until=until, down=str(down), attempts="2")
        rows.writeStream.format("parquet").option("path", str(tmp_path / "days")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["code"], int(r["close"])) for r in spark.read.schema(history.SCHEMA).parquet(str(tmp_path / "days")).collect())

    assert land("2024-01-04") == [(c, k) for c in "ab" for k in range(4)]
    assert land("2024-01-04") == [(c, k) for c in "ab" for k in range(4)]
    down.touch()
    with pytest.raises(Exception, match="no answer"):
        land("2024-01-10")
    down.unlink()
    # the batch that failed is read again, once
    assert land("2024-01-10") == [(c, k) for c in "ab" for k in range(10)]
