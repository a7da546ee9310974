"""The table of commits: writers that die or collide, late and forced bars, streams that are run again."""

import datetime

import pytest

from tapeline.sources.ledger import BarTable, Conflict


def bars(spark, rows):
    return spark.createDataFrame([(c, datetime.date.fromisoformat(d) if d else None, p, f) for c, d, p, f in rows], "code string, date date, close double, forced boolean")


def held(table, **which):
    return sorted((r["code"], str(r["date"]), r["close"]) for r in table.read(**which).collect())


def test_late_and_forced_bars(spark, tmp_path):
    table = BarTable(spark, str(tmp_path))
    assert held(table) == [] and table.versions() == []
    table.merge(bars(spark, [("a", "2024-01-02", 1.0, False), ("a", "2024-02-01", 2.0, False), ("b", "2024-02-05", 3.0, False)]))
    status = table.merge(bars(spark, [("a", "2024-02-01", 9.0, False), ("b", "2024-02-05", 4.0, True), ("b", "2024-02-06", None, False), ("c", None, 1.0, False), (None, "2024-02-06", 1.0, False)]))
    assert sorted((r["code"], str(r["date"]), r["status"]) for r in status.collect()) == [("a", "2024-02-01", "exists"), ("b", "2024-02-05", "written"), ("b", "2024-02-06", "skip")]
    first, second = table.manifest(1), table.manifest()
    # a month without a written day keeps its folder
    assert second.version == 2 and first.months["2024-01"] == second.months["2024-01"] and first.months["2024-02"]["folder"] != second.months["2024-02"]["folder"]
    assert held(table) == [("a", "2024-01-02", 1.0), ("a", "2024-02-01", 2.0), ("b", "2024-02-05", 4.0)] and held(table, version=1)[-1] == ("b", "2024-02-05", 3.0)
    assert held(table, months=["2024-01"]) == [("a", "2024-01-02", 1.0)] and held(table, months=["2030-01"]) == [] and second.done == ["2024-01"]
    table.merge(bars(spark, [("a", "2024-02-01", 9.0, False)]))
    assert table.versions() == [1, 2]  # nothing written, nothing committed
    left = {r["month"]: (str(r["first"]), r["days"]) for r in table.pending(bars(spark, [("x", d, 1.0, False) for d in ("2024-01-31", "2024-02-05", "2024-02-07", "2024-02-08", "2024-03-01")])).collect()}
    assert left == {"2024-02": ("2024-02-07", 2), "2024-03": ("2024-03-01", 1)}
    assert len(table.unnamed()) == 0 or table.unnamed(2) == []


def test_a_writer_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    table = BarTable(spark, str(tmp_path))
    table.merge(bars(spark, [("a", "2024-01-02", 1.0, False)]))
    with monkeypatch.context() as m:
        m.setattr(BarTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            table.merge(bars(spark, [("a", "2024-01-02", 5.0, True), ("a", "2024-01-03", 2.0, False)]))
    assert held(table) == [("a", "2024-01-02", 1.0)] and len(table.unnamed()) == 1
    table.merge(bars(spark, [("a", "2024-01-03", 2.0, False)]))
    assert held(table) == [("a", "2024-01-02", 1.0), ("a", "2024-01-03", 2.0)]


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    one, two = BarTable(spark, str(tmp_path)), BarTable(spark, str(tmp_path))
    one.merge(bars(spark, [("a", "2024-01-02", 1.0, False)]))
    seen = one.manifest()
    two.merge(bars(spark, [("b", "2024-01-02", 2.0, False)]))
    with monkeypatch.context() as m:
        m.setattr(one, "manifest", lambda version=None: seen)
        with pytest.raises(Conflict):
            one.merge(bars(spark, [("c", "2024-01-02", 3.0, False)]))
    one.merge(bars(spark, [("c", "2024-01-02", 3.0, False)]))
    assert [x[0] for x in held(two)] == ["a", "b", "c"]


def test_batches_count_once(spark, tmp_path):
    table = BarTable(spark, str(tmp_path / "t"))
    table.merge(bars(spark, [("a", "2024-01-02", 1.0, False)]), "s", 0)
    assert table.merge(bars(spark, [("a", "2024-01-02", 7.0, True)]), "s", 0).count() == 0 and held(table) == [("a", "2024-01-02", 1.0)]
    table.merge(bars(spark, [("a", "2024-01-02", 7.0, True)]), "other", 0)
    assert held(table) == [("a", "2024-01-02", 7.0)] and table.manifest().batches == {"s": 0, "other": 0}


def test_stream_killed_between_commit_and_checkpoint(spark, tmp_path, monkeypatch):
    table = BarTable(spark, str(tmp_path / "t"))
    for day, price in (("2024-01-02", 1.0), ("2024-01-03", 2.0)):
        bars(spark, [("a", day, price, True)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        given = spark.readStream.schema("code string, date date, close double, forced boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        table.follow(given, "s", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()

    merge = BarTable.merge

    def merge_and_die(self, rows, stream, number):
        merge(self, rows, stream, number)
        if number == 1:
            raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(BarTable, "merge", merge_and_die)
        with pytest.raises(Exception, match="killed"):
            run()
    versions = table.versions()
    run()  # the second batch comes again
    assert table.versions() == versions and held(table) == [("a", "2024-01-02", 1.0), ("a", "2024-01-03", 2.0)]
