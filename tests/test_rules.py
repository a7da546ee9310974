"""Rails, masks and the rule machine against plain Python."""

import math
import random

import numpy as np
import pytest

from tapeline.operators import rails, rules, scans


def test_trend_is_the_fit_at_the_last_bar():
    rng = np.random.default_rng(0)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 400)))
    close[[0, 77, 78, 200]] = [np.nan, np.nan, -1, 0]
    for bars, least in ((126, 63), (21, 63), (504, 63)):
        path, growth = rails.trend(close, bars, least)
        for t in range(len(close)):
            part = close[max(0, t + 1 - bars) : t + 1]
            ok = np.flatnonzero(np.isfinite(part) & (part > 0))
            if len(ok) >= min(least, bars):
                b, a = np.polyfit(ok, np.log(part[ok]), 1)
                assert math.isclose(path[t], math.exp(a + b * ok[-1]), rel_tol=1e-8) and math.isclose(growth[t], math.exp(b * 252) - 1, rel_tol=1e-6, abs_tol=1e-9)
    first, last = close[1], close[10]
    path, growth = rails.trend(close, 504)
    assert np.isnan(path[:2]).all() and path[10] == last and math.isclose(growth[10], (last / first) ** (252 / 9) - 1)
    assert np.isnan(rails.trend(np.array([]), 21)[0]).all()


def test_quantile_so_far():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, 300), 1)
    x[[3, 60]] = np.nan, np.inf
    got = rails.quantile_so_far(x, 0.95, 5)
    for t in range(len(x)):
        seen = x[: t + 1][np.isfinite(x[: t + 1])]
        assert np.isnan(got[t]) if len(seen) < 5 else math.isclose(got[t], np.quantile(seen, 0.95), abs_tol=1e-12)


def test_share_up_to():
    x = np.array([3.0, 1, np.nan, 2, 2, 5, 0, 2])
    got = rails.share_up_to(x, 4, step=3)
    for t, v in enumerate(x):
        seen = x[max(0, t - 3) : t + 1]
        seen = seen[np.isfinite(seen)]
        assert np.isnan(got[t]) if np.isnan(v) else got[t] == (seen <= v).mean()


def machine(close, buy, sell, g1, trail):
    """Target weights bar by bar: (trades, equity, last action)."""
    target, trades, fill, peak, latch, action = [0.0], 0, None, None, False, "none"
    for i, c in enumerate(close):
        action = "none"
        if fill is None:
            if buy[i]:
                fill, peak, latch, action = i + 1, None, False, "buy"
            target.append(float(fill is not None))
            continue
        if i >= fill:
            peak = c if peak is None else max(peak, c)
        latch = latch or g1[i]
        out = i >= fill and ((sell[i] and not latch) or (bool(trail) and i > fill and c <= peak * (1 - trail)))
        action = "sell" if out else "hold"
        target.append(0.0 if out else 1.0)
        if out:
            trades += i + 1 < len(close)
            fill = None
    equity = 1.0
    for t in range(len(close)):
        weight, before = (target[t - 1] if t else 0.0), (target[t - 1] if t else 0.0)
        equity *= 1 + weight * (close[t] / close[t - 1] - 1 if t else 0) - abs(target[t] - before) * 0.0005
    return trades, equity, action


def test_rule_machine_with_latch_and_trail():
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randint(1, 60)
        close = [100.0]
        for _ in range(n - 1):
            close.append(close[-1] * math.exp(rng.gauss(0, 0.05)))
        buy, sell, g1 = ([rng.random() < p for _ in range(n)] for p in (0.2, 0.2, 0.1))
        trail = rng.choice([0.0, 0.05, 0.15])
        got = scans.rule_machine(close, buy, sell, g1=g1, trail=trail)
        trades, equity, action = machine(close, buy, sell, g1, trail)
        assert (len(got["trades"]), got["action"]) == (trades, action) and math.isclose(got["equity"][-1], equity, rel_tol=1e-12)
    # a latched position doesn't sell; the last bar says so
    got = scans.rule_machine([1.0, 1.0, 1.1, 1.2], [True, False, False, False], [False, False, False, True], g1=[False, True, False, False])
    assert got["action"] == "hold" and got["masked"] and got["latch"]


STATES = [
    (None, False, False, False, False, False, "no rail"), (10.0, True, True, False, False, False, "blocked as fast"), (10.0, False, True, True, False, False, "buy today"), (10.0, False, False, False, True, False, "rail is enough"),
    (10.0, False, False, False, False, False, "aux incomplete"), (10.0, False, False, False, True, True, "aux incomplete"), (10.0, False, False, False, False, True, "aux incomplete"),
]


def test_flat_quotes(spark):
    from pyspark.sql import functions as F

    rows = [(i, lo, block, fast, buy, True, disc, near, False) for i, (lo, block, fast, buy, disc, near, _) in enumerate(STATES)]
    rows += [(100, 10.0, False, False, False, False, False, True, True), (101, 10.0, False, False, False, False, True, False, True)]
    df = spark.createDataFrame(rows, "id int, fig9_lower double, fast_block boolean, fast boolean, buy boolean, use_b1 boolean, disc_ok boolean, near_lo boolean, aux_buy boolean")
    price, status = rules.flat_quote()
    got = {r["id"]: (r["p"], r["s"]) for r in df.select("id", price.alias("p"), status.alias("s")).collect()}
    assert [got[i][1] for i in range(len(STATES))] == [s[-1] for s in STATES] and got[1][0] == pytest.approx(10.1)
    assert got[100][1] == "in band already" and got[101][1] == "price missing"
    assert {r["s"] for r in df.select(rules.flat_quote(F.lit(False))[1].alias("s")).collect()} == {"no rail", "rule not applicable"}


def test_recommendations(spark):
    checked = spark.createDataFrame([("a", "buy", 0.3), ("b", "buy", 0.1), ("c", "buy", 0.2), ("d", "hold", 0.0), ("e", "buy", 0.5), ("f", "buy", None)], "code string, action string, dist_lo9 double")
    clusters = spark.createDataFrame([("A", 1, False, 5.0), ("b", 1, False, -9.0), ("b", 7, False, 1.0), ("c", 2, True, 0.0), ("d", 2, True, 99.0), ("e", 2, False, 50.0)], "code string, cluster int, is_representative boolean, ret20_pct double")
    got = {r["code"]: r["recommend"] for r in rules.recommended(checked, clusters).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False, "e": False, "f": True}
    assert rules.recommended(checked.limit(0), clusters).count() == 0


def test_snapshot_takes_the_day_asked_for(spark):
    from pyspark.sql import functions as F

    from tapeline.plans import rule_queries

    found = rules.evaluate(*rule_queries.parts(spark, "/root/testdata/sf0.001"), as_of=F.lit("2001-11-04").cast("date"))
    rows = found.collect()
    assert 0 < len(rows) < 6 and {str(r["date"]) for r in rows} == {"2001-11-04"}
    assert all((name in r["triggers"].split("; ")) == bool(r[flag]) for r in rows for name, flag in rules.TRIGGERS)
