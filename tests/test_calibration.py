"""Running sums, cross-fitted scores, isotonic calibration and alerts, against plain Python."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeline.operators import alerts, calibration
from tapeline.operators.prefix import running


def test_running(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, 500)
    rows = pd.DataFrame({"x": x, "n": rng.integers(0, 9, 500)})
    got = running(spark.createDataFrame(rows).repartition(7), -F.col("x"), {"up": "n"}).toPandas()
    assert len(got) == 500 and all(g.up == rows.n[rows.x >= g.x].sum() for g in got.itertuples())
    assert running(spark.createDataFrame(rows).limit(0), F.col("x"), {"up": "n"}).count() == 0


def newton(x, y, c=1.0):
    z = np.column_stack([x, np.ones(len(x))])
    ridge, w = np.append(np.ones(x.shape[1]), 0), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(np.diag(ridge) + c * (z.T * (p * (1 - p))) @ z, ridge * w + c * z.T @ (p - y))
    return w


def test_crossfit_equals_a_fit_a_month(spark):
    rng = np.random.default_rng(0)
    n = 700
    rows = pd.DataFrame({"code": [f"c{i}" for i in range(n)], "month": np.sort(rng.integers(1, 8, n)).astype(str), "a": rng.normal(size=n), "b": rng.normal(size=n) * 30})
    rows["label"] = pd.Series(rng.random(n) < 1 / (1 + np.exp(-rows.a - rows.b / 30)), dtype=object)
    rows.loc[rows.month == "3", "label"] = None
    rows.loc[5, "a"] = np.inf
    df = spark.createDataFrame(rows.to_dict("records"), "code string, month string, a double, b double, label boolean")
    got = calibration.crossfit(df, ["a", "b"]).toPandas()
    known = rows[rows.label.notna() & np.isfinite(rows.a)]
    months = sorted(known.month.unique())
    want = []
    for i, m in enumerate(months):
        past, now = known[known.month < m], known[known.month == m]
        if len(past) >= 80:
            w = newton(past[["a", "b"]].to_numpy(), past.label.astype(float).to_numpy())
            want.append(now.assign(p=1 / (1 + np.exp(-(now[["a", "b"]].to_numpy() @ w[:2] + w[2]))), i=i))
    want = pd.concat(want).merge(got, on="code", suffixes=("", "_"))
    assert len(want) == len(got) > 300 and np.allclose(want.p, want.p_raw, atol=1e-6) and (want.i == want.train_months).all() and "3" not in set(got.month)
    # what is later has no influence, and few rows or one class give nothing
    turned = calibration.crossfit(df.withColumn("label", F.when(F.col("month") == "7", ~F.col("label")).otherwise(F.col("label"))), ["a", "b"]).toPandas()
    assert np.allclose(turned.sort_values("code").p_raw, got.sort_values("code").p_raw)
    assert calibration.crossfit(df.limit(50), ["a", "b"]).count() == 0 and calibration.crossfit(df.withColumn("label", F.lit(True)), ["a", "b"]).count() == 0 and calibration.crossfit(df.limit(0), ["a", "b"]).count() == 0


def test_steps_that_overshoot_are_halved(spark):
    """Classes that are far apart, where plain steps from zero would jump back and forth."""
    x = np.concatenate([np.full(60, 0.01), np.full(60, 500.0), np.full(5, -400.0)])
    y = np.concatenate([np.arange(60) % 2, np.ones(60), np.zeros(5)]).astype(int)
    rows = spark.createDataFrame([("1", int(b), float(a)) for a, b in zip(x, y, strict=True)] + [("2", 1, 0.0)], "month string, y int, a double")
    months, w, fits = calibration.expanding_weights(rows, ["a"])
    p = 1 / (1 + np.exp(-(x * w[1, 0] + w[1, 1])))
    assert months == ["1", "2"] and fits.tolist() == [False, True] and abs(w[1, 0] + x @ (p - y)) < 1e-5 and abs((p - y).sum()) < 1e-5


def rising(score, y):
    """Largest over starts of the smallest over ends of means."""
    at = np.unique(score)
    return {at[i]: max(min(y[(score >= at[a]) & (score <= at[b])].mean() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))}


def test_isotonic(spark):
    rng = np.random.default_rng(2)
    for k, n in ((40, 300), (15, 60), (1, 5)):
        score = rng.integers(0, k, n) / k
        y = rng.random(n) < score
        want = rising(score, y.astype(float))
        df = spark.createDataFrame(pd.DataFrame({"s": score, "y": y})).repartition(5)
        blocks = calibration.isotonic_blocks(df, "s", "y").orderBy("low").collect()
        values = [b["y"] / b["n"] for b in blocks]
        assert values == sorted(set(values)) and sum(b["n"] for b in blocks) == n
        assert all(np.isclose(want[s], next(b["y"] / b["n"] for b in blocks if b["low"] <= s <= b["high"])) for s in want)


def test_calibrated(spark, monkeypatch):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(2000) * 60) / 60
    rows = pd.DataFrame({"s": s, "y": rng.random(2000) < s**2})
    df = spark.createDataFrame(rows)
    want = rising(s, rows.y.to_numpy(float))
    for least in (100_000, 0):
        monkeypatch.setattr(calibration, "BROADCAST_ROWS", least)
        out, done = calibration.calibrated(df, "s", "y")
        got = out.toPandas()
        assert done and len(got) == 2000 and np.allclose([want[x] for x in got.s], got.p_cal)
    more, _ = calibration.calibrated(df.unionByName(spark.createDataFrame([(None, True), (0.5, None)], "s double, y boolean")), "s", "y")
    assert more.count() == 2002 and more.where("s IS NULL").first()["p_cal"] is None and more.where("y IS NULL").first()["p_cal"] is not None
    for few in (df.limit(400), df.withColumn("y", F.lit(True)), df.withColumn("y", F.lit(False)), df.limit(0), df.withColumn("s", F.lit(0.5))):
        out, done = calibration.calibrated(few, "s", "y")
        assert done == (few.limit(1).count() > 0 and False) and out.where("p_cal <> s").count() == 0
    points = spark.createDataFrame([(float(x), 1, k + 1) for k, x in enumerate(sorted(rows.s))], "score double, n long, up_to long")
    assert np.allclose(calibration.quantile(points.limit(2000), (0.8, 0.9, 0.5)), np.quantile(np.sort(rows.s), [0.8, 0.9, 0.5]))


# ---- alerts


def one_after_the_other(found, events, inside, gap):
    """Events in order of their onset take the free alert that is nearest, then earliest, then highest; the rest of their window repeats it."""
    free, out = set(range(len(found))), {}
    for code, onset in sorted(set(events), key=lambda e: (e[1], e[0])):
        near = [i for i in free if found[i][0] == code and inside(found[i][1], onset, code)]
        if near:
            best = min(near, key=lambda i: (abs(gap(found[i][1], onset, code)), found[i][1], -(found[i][2] or 0)))
            for i in near:
                out[i] = (onset, gap(found[i][1], onset, code), False, False) if i == best else (None, None, True, False)
            free -= set(near)
    return [(*found[i][:2], *out.get(i, (None, None, False, True))) for i in range(len(found))]


def test_alerts_against_a_loop(spark):
    rng = np.random.default_rng(4)
    start = datetime.date(2024, 1, 1)
    day = lambda k: start + datetime.timedelta(int(k))
    picks = sorted({(f"c{c}", day(k)) for c, k in zip(rng.integers(0, 3, 160), rng.integers(0, 300, 160), strict=True)})
    found = [(c, d, float(x)) for (c, d), x in zip(picks, np.round(rng.random(len(picks)), 1), strict=True)]
    events = [(f"c{c}", day(k)) for c, k in zip(rng.integers(0, 4, 40), rng.integers(0, 300, 40), strict=True)]
    events += events[:3]
    a = spark.createDataFrame(found, "code string, date date, score double")
    e = spark.createDataFrame(events, "code string, onset date")

    def inside(d, onset, code):
        return pd.Timestamp(onset) - pd.tseries.offsets.BDay(3) <= pd.Timestamp(d) <= pd.Timestamp(onset) + pd.tseries.offsets.BDay(10)

    got = alerts.matched(a, e).select("code", "date", "onset", "delay", "duplicate", "false_alarm")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, one_after_the_other(found, events, inside, lambda d, o, _: (d - o).days)))
    calendar = [(f"c{c}", day(k)) for c in range(4) for k in range(0, 300, 1 + c)]
    place = {}
    for c, d in calendar:
        place[c, d] = sum(1 for c2, _ in place if c2 == c)
    got = alerts.matched(a, e, 2, 6, spark.createDataFrame(calendar, "code string, date date")).select("code", "date", "onset", "delay", "duplicate", "false_alarm")
    want = one_after_the_other(found, [x for x in events if x in place], lambda d, o, c: (c, d) in place and -2 <= place[c, d] - place[c, o] <= 6, lambda d, o, c: place[c, d] - place[c, o])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_odd_alerts(spark):
    d = datetime.date(2024, 3, 6)
    a = spark.createDataFrame([("a", d, None), ("a", d, 0.4), ("a", d, 0.4), ("a", None, 1.0), (None, d, 1.0), ("b", d, float("nan"))], "code string, date date, score double")
    e = spark.createDataFrame([("a", d), ("a", d), (None, d), ("a", None)], "code string, onset date")
    got = alerts.matched(a, e)
    assert got.count() == 6 and got.where("onset IS NOT NULL").collect()[0]["score"] == 0.4 and got.where("duplicate").count() == 2 and got.where("false_alarm").count() == 3
    assert alerts.matched(a.limit(0), e).count() == 0 and alerts.matched(a, e.limit(0)).where("false_alarm").count() == 6
