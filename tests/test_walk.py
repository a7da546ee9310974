"""The walk-forward run against plain Python."""

import math

import numpy as np
import pandas as pd
import pytest

from tapeline.operators import calibration, hmm, transition, walk


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(5)
    scale = np.where(np.arange(620) // 60 % 2, 0.03, 0.008)
    return 100 * np.exp(np.cumsum(rng.standard_t(5, 620) * scale))


def test_mixture_moments():
    w, mu, sigma = np.array([0.4, 0.8]), np.array([0.0, 0.01]), np.array([0.01, 0.03])
    grid = np.linspace(-3, 3, 600_001)
    density = sum(a * 8 / (3 * math.pi * math.sqrt(5)) * (1 + ((grid - m) / s) ** 2 / 5) ** -3 / s for a, m, s in zip(w / w.sum(), mu, sigma, strict=True))
    got = walk.mixture(0.02, w, mu, sigma)
    step = grid[1] - grid[0]
    assert math.isclose(got["cdf"], density[grid <= 0.02].sum() * step, abs_tol=1e-3) and math.isclose(got["mean"], (grid * density).sum() * step, abs_tol=1e-6)
    assert math.isclose(got["scale"] ** 2, ((grid - got["mean"]) ** 2 * density).sum() * step, rel_tol=1e-3) and math.isclose(math.exp(got["log_density"]), np.interp(0.02, grid, density), rel_tol=1e-6)
    assert walk.mixture(0.0, np.zeros(2), mu, sigma)["cdf"] is None and math.isclose(float(walk.t_cdf(2.0)), 0.94903026, abs_tol=1e-8)


def day(r, **more):
    """Readings of the last of returns, as far as jumps go."""
    r = np.asarray(r, float)
    long = len(r) >= 21
    return {"now": float(r[-1]), "std20": float(r[-20:].std(ddof=1)) if long else None, "mean5": float(r[-5:].mean()), "mean5_before": float(r[-6:-1].mean()), "return_z": walk.return_z(r), "prev": "calm", "raw": "calm", "p_transition": 0.0, "emission_surprise": 0.0, "separated": True, "p_into_reversal": 0.0, "pred_cdf": 0.5} | more


READINGS = "now double, std20 double, mean5 double, mean5_before double, return_z double, prev string, raw string, p_transition double, emission_surprise double, separated boolean, p_into_reversal double, pred_cdf double"


def test_jump_evidence(spark):
    calm = np.tile([0.01, -0.01], 12)
    up = np.append(calm, 0.05)
    z = 0.05 / calm[-20:].std(ddof=1)
    assert math.isclose(walk.return_z(up), z) and walk.return_z(up[:20]) is None
    days = [day(up, prev=hmm.NAMES[1]), day(-up, prev=hmm.NAMES[2]), day(up), day(calm), day(calm, separated=False), day(up[:20], separated=False), day(-up, separated=False)]
    df = spark.createDataFrame(days, READINGS).select(transition.jump_score().alias("jump"), transition.jump_state().alias("state"), transition.rule_score().alias("rule"), transition.jump_evidence().alias("evidence"))
    got = df.collect()
    scale = min(0.05 / up[-20:].std(ddof=1) / 3.75, 1)
    assert [round(r["jump"], 9) for r in got[:2]] == [round(0.85 * scale, 9), round(0.7 * scale, 9)] and [r["state"] for r in got[:2]] == [hmm.NAMES[2], hmm.NAMES[1]]
    assert (round(got[2]["jump"], 9), got[2]["state"]) in ((round(0.6 * scale, 9), hmm.NAMES[2]), (round(0.35 * scale, 9), None)) and (got[3]["jump"], got[3]["state"]) == (0.0, None)
    assert math.isclose(got[0]["evidence"], min((z - 2.5) / 2.5, 1)) and got[1]["evidence"] == 0 and got[3]["rule"] == got[4]["rule"] == got[5]["rule"] == got[5]["jump"] == 0.0
    mean = (-up)[-5:].mean()
    assert got[6]["rule"] == (0.7 if mean > 0 or abs(mean) < 1e-12 else 0.0)


def test_ambiguity(spark):
    even, one = [1 / 3] * 3, [0.99, 0.005, 0.005]
    mu, sigma = [0.0, -0.01, 0.01], [0.01, 0.02, 0.03]
    rows = [
        ("a", "1", True, None, 1.5, mu, sigma, even, 0.02), ("b", "1", True, None, 1.01, [0.0, 0.0, 0.001], [0.01, 0.0101, 0.03], even, 0.02), ("c", "1", True, None, 1.5, mu, sigma, one, 0.02),
        ("d", "1", True, None, 1.5, [mu[i] for i in (0, 2, 1)], [sigma[i] for i in (0, 2, 1)], even, 0.02), ("d", "2", True, None, 1.5, mu, sigma, even, 0.02), ("e", "1", False, "fit_unreliable", None, None, None, None, None), ("e", "2", True, None, 1.5, mu, sigma, even, 0.02),
    ]
    df = spark.createDataFrame(rows, "code string, month string, reliable boolean, failure string, separation double, mu array<double>, sigma array<double>, mass array<double>, typical double")
    found = lambda drift: {(r["code"], r["month"]): (r["ambiguous"], r["reasons"].split("|") if r["reasons"] else []) for r in transition.with_doubts(df, drift).collect()}
    got = found(False)
    assert got["a", "1"] == (False, []) and got["b", "1"] == (True, ["sigma_not_separated", "direction_mu_not_separated"])
    assert got["c", "1"][0] and "single_state_collapse" in got["c", "1"][1] and got["e", "1"] == (True, ["fit_unreliable"]) and got["d", "2"] == (False, [])
    drifted = found(True)
    assert drifted["d", "2"] == (True, ["semantic_label_drift"]) and drifted["e", "2"] == (False, []) and drifted["a", "1"] == (False, [])


def test_steps_carry_the_filter(spark, prices):
    """Step by step the weights are those of the filter over all returns, and readings stay in their bounds."""
    r = walk.kept_returns(prices, 600)
    m = hmm.named(hmm.fit(r[:252]))
    alpha = hmm.filtered(r[:300], m)[-1]
    days = []
    for t in range(300, 340):
        row, alpha = walk.step(r[: t + 1], m, alpha)
        days.append(row)
        assert np.allclose(alpha, hmm.filtered(r[: t + 1], m)[-1], atol=1e-9)
    days.append(walk.step(np.append(r[:300], 12 * r[:300].std()), m, hmm.filtered(r[:300], m)[-1])[0])
    got = [x.asDict() for x in transition.with_rules(spark.createDataFrame(pd.DataFrame(days))).collect()]
    for row in got:
        assert 0 <= row["transition_score"] <= 1 and 0 <= row["pred_cdf"] <= 1 and row["quantile_switch"] == (row["pred_cdf"] >= 0.9 or row["pred_cdf"] <= 0.1)
        if row["switch_side"] == "up":
            assert row["direction"] == "up" and row["transition_score"] >= 0.5 and row["p_into_reversal_adj"] >= 0.5 and row["regime_now"] == hmm.NAMES[2]
    assert got[-1]["quantile_switch"] and got[-1]["return_z"] > 5 and got[-1]["transition_score"] > 0.9


def test_scored_days_equal_a_loop(spark, prices):
    days = pd.bdate_range("2020-01-01", periods=len(prices)).date
    bars = pd.DataFrame([(c, d, float(p) * k) for c, k in (("a", 1.0), ("b", 2.0)) for d, p in zip(days, prices, strict=True)], columns=["code", "date", "close"])
    bars = pd.concat([bars, pd.DataFrame([("short", days[-1], 5.0), ("short", days[-2], 4.0)], columns=bars.columns)])
    df = spark.createDataFrame(bars, "code string, date date, close double")
    labels = df.selectExpr("code", "date", "close > 0 AS label")
    got = walk.walk_forward(df, labels, "2021-10").toPandas()
    assert set(got.code) == {"a", "b"} and got[["code", "date"]].duplicated().sum() == 0 and got.label.all()
    months = sorted(set(got.month))
    for month in months[:2]:
        here = [i for i, d in enumerate(days) if d.strftime("%Y-%m") == month]
        m = hmm.named(hmm.fit(walk.kept_returns(prices[: here[0]], 252)))
        alpha = None
        for i in here:
            r = walk.kept_returns(prices[: i + 1], 252)
            if alpha is None:
                alpha = hmm.filtered(r[-41:-1], m)[-1]
            row, alpha = walk.step(r, m, alpha)
            found = got[(got.code == "a") & (got.date == days[i])].iloc[0]
            assert all(math.isclose(found[c], row[c], abs_tol=1e-9) for c in ("pred_cdf", "p_transition", "emission_surprise", "p_into_reversal", "std20")) and found.raw == row["raw"] and found.prev == row["prev"]


def test_thresholds(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"month": rng.integers(1, 9, 600).astype(str), "p_cal": np.round(rng.random(600), 2)})
    rows["label"] = rng.random(600) < rows.p_cal
    df = spark.createDataFrame(rows)
    judged = spark.createDataFrame(calibration.judged_thresholds(df, rounds=50).toPandas())
    by_score = {round(r["score"], 2): r for r in judged.collect()}
    got = calibration.fdr_threshold(judged, 0.35, 30)
    assert got["q_confirm"] is not None
    some = rows[rows.p_cal >= got["q_confirm"]]
    assert len(some) == got["n_support"] >= 30 and (~some.label).mean() <= 0.35
    drawn = calibration.replicates(df, 50).toPandas()
    assert drawn.replicate.nunique() == 50 and not drawn.duplicated().any() and 4 < drawn.groupby("replicate").size().mean() < 6.5
    best = None
    for q in sorted(rows.p_cal.unique(), reverse=True):
        mine = rows[rows.p_cal >= q]
        shares = [1 - part.label.mean() for _, ms in drawn.groupby("replicate").month if len(part := mine[mine.month.isin(ms)])]
        found = by_score[q]
        assert found["n"] == len(mine) and math.isclose(found["upper"], np.quantile(shares, 0.95), abs_tol=1e-9) and math.isclose(found["false_share"], 1 - mine.label.mean(), abs_tol=1e-9)
        if best is None and len(mine) >= 30 and np.quantile(shares, 0.95) <= 0.35:
            best = q
    assert best == got["q_confirm"]
    assert calibration.fdr_threshold(calibration.judged_thresholds(df.limit(0)), 0.35)["reason"] == "no_crossfit_rows" and calibration.fdr_threshold(calibration.judged_thresholds(df.selectExpr("month", "p_cal", "false AS label")), 0.35)["reason"] == "no_threshold_meets_fdr"
    one = calibration.judged_thresholds(df.selectExpr("'m' AS month", "p_cal", "label")).first()
    assert one["upper"] == one["false_share"]


def test_fallback_ladders(spark):
    pool = pd.DataFrame({"label": [True] * 20 + [False] * 40, "return_z": 1.0, "direction_up": True, "ambiguous": False, "pred_cdf": [0.996] * 20 + [0.5] * 40, "p_cal": 0.3})
    chosen = lambda rows, thr: calibration.fallback_threshold(spark.createDataFrame(rows), thr)
    got = chosen(pool, {})
    assert got["cdf_confirm"] == 0.95 and got["mode"] == "pred_cdf_beat_z_baseline" and got["n_support"] == 20  # the last of equals
    by_score = chosen(pool.assign(pred_cdf=0.5, p_cal=[0.9] * 20 + [0.1] * 40), {})
    assert by_score["q_confirm"] == 0.9 and by_score["cdf_confirm"] is None and by_score["mode"] == "beat_z_baseline"
    by_z = chosen(pool.assign(pred_cdf=0.5, return_z=[3.1] * 25 + [1.0] * 35, label=[True] * 25 + [False] * 35), {})
    assert by_z["z_confirm"] in (2.5, 2.75, 3.0) and by_z["mode"] == "z_ladder_match"
    assert chosen(pool.iloc[:5].assign(label=False), {"reason": "x"})["mode"] == "none"


def rung_by_rung(pool):
    """The ladders one rung after the other, as the rules are written."""
    y, z, up = pool.label.to_numpy(bool), pool.return_z.to_numpy(), pool.direction_up.to_numpy(bool)
    base = y.mean()
    jump = (z >= 2.5) & up
    floor = y[jump].mean() if jump.sum() >= 10 else base
    ladders = [(1, 20, 15, [(v, pool.pred_cdf.to_numpy() >= v) for v in (0.995, 0.99, 0.97, 0.95)], max(base + 0.05, floor)), (2, 30, 20, [(v, pool.p_cal.to_numpy() >= v) for v in np.unique(pool.p_cal)[::-1]], max(base + 0.05, floor))]
    ladders.append((3, 0, 20, [(v, (z >= v) & up & ~pool.ambiguous.to_numpy(bool)) for v in (4.0, 3.5, 3.0, 2.75, 2.5)], floor))
    for kind, least_pool, least, steps, weak in ladders:
        best, strong = None, False
        for v, on in steps:
            if len(pool) < least_pool or on.sum() < least:
                continue
            p = y[on].mean()
            if p >= floor + 0.05 and (not strong or p >= best[1]):
                best, strong = (kind, v, p), True
                best = (v, p)
            elif not strong and p >= weak and (best is None or p >= best[1]):
                best = (v, p)
        if best:
            return kind, best[0], strong
    return None


def test_ladders_in_turn(spark):
    rng = np.random.default_rng(8)
    seen = set()
    for k in range(8):
        n = int(rng.integers(15, 300))
        z = rng.normal(1, 2, n)
        skill = (0.0, 0.1, 0.4, 0.9)[k % 4]
        pool = pd.DataFrame({"return_z": z, "direction_up": z > 0, "ambiguous": rng.random(n) < 0.1, "pred_cdf": np.round(rng.random(n) ** (0.1 if k < 4 else 2), 3), "p_cal": np.round(rng.random(n), 1)})
        pool["label"] = rng.random(n) < 0.2 + skill * (pool.p_cal if k % 2 else pool.pred_cdf) * 0.8
        table, _ = calibration.ladder(spark.createDataFrame(pool))
        best = table.where("place = 1").first()
        want = rung_by_rung(pool)
        assert (best and (best["kind"], best["value"], best["beats"])) == want
        seen.add(want and want[0])
    assert len(seen) > 2


def test_go_no_go(spark):
    rng = np.random.default_rng(3)
    n = 400
    rows = pd.DataFrame({"code": [f"c{i % 5}" for i in range(n)], "date": pd.to_datetime("2020-01-01") + pd.to_timedelta(np.arange(n), "D"), "quantile_switch": np.arange(n) % 5 == 0, "direction_up": True, "return_z": np.where(np.arange(n) % 7 == 0, 3.0, 0.5), "is_candidate": True, "p_cal": 0.5})
    rows["date"], rows["month"] = rows.date.dt.date, rows.date.dt.strftime("%Y-%m")
    rows["label"] = rng.random(n) < 0.5
    rows["signal_level"] = np.where(np.arange(n) % 10 == 0, "CONFIRM", "NONE")
    rows.loc[rows.signal_level == "CONFIRM", "label"] = True
    schema = "code string, date date, quantile_switch boolean, direction_up boolean, return_z double, is_candidate boolean, p_cal double, month string, label boolean, signal_level string"
    got = calibration.go_no_go(spark.createDataFrame(rows, schema))
    z = rows[(rows.return_z >= 2.5)]
    assert got["n_confirm"] == 40 and got["precision"] == 1.0 and math.isclose(got["precision_z"], z.label.mean()) and math.isclose(got["switch_rate"], 0.2)
    assert math.isclose(got["brier"], 0.25) and math.isclose(got["ece"], abs(rows.label.mean() - 0.5)) and got["checks"]["switch_coverage"] and got["checks"]["threshold"] and got["pass"] == all(got["checks"].values())
    none = calibration.go_no_go(spark.createDataFrame(rows.assign(signal_level="NONE"), schema))
    assert none["suppressed"] and none["checks"]["precision"] and none["false_per_code_year"] == 0


def test_signals_run_end_to_end(spark):
    rng = np.random.default_rng(4)
    n = 900
    z = rng.normal(0, 1.5, n)
    rows = pd.DataFrame({"code": [f"c{i % 6}" for i in range(n)], "date": [d.date() for d in pd.bdate_range("2019-01-01", periods=150) for _ in range(6)], "return_z": z, "pred_cdf": np.asarray(walk.t_cdf(z)), "transition_score": np.minimum(1, np.abs(z) / 3), "p_into_reversal_adj": np.clip(z / 4, 0, 1)})
    rows["month"] = [d.strftime("%Y-%m") for d in rows.date]
    rows = rows.assign(p_into_reversal=rows.p_into_reversal_adj, p_state_reversal=0.3, p_switch=0.1, p_no_exit_h10=0.5, emission_surprise=np.abs(z), direction=np.where(z > 0.5, "up", "mixed"), direction_up=z > 0.5, quantile_switch=(rows.pred_cdf >= 0.9) | (rows.pred_cdf <= 0.1), ambiguous=False)
    rows["switch_side"] = np.where(rows.pred_cdf >= 0.9, "up", np.where(rows.pred_cdf <= 0.1, "down", None))
    rows["label"] = pd.Series(rng.random(n) < 1 / (1 + np.exp(-z)), dtype=object)
    rows.loc[rows.index[-30:], "label"] = None
    df = spark.createDataFrame(rows[["code", "date", "month", *[c for c in rows.columns if c not in ("code", "date", "month")]]].to_dict("records"), "code string, date date, month string, return_z double, pred_cdf double, transition_score double, p_into_reversal_adj double, p_into_reversal double, p_state_reversal double, p_switch double, p_no_exit_h10 double, emission_surprise double, direction string, direction_up boolean, quantile_switch boolean, ambiguous boolean, switch_side string, label boolean")
    found, facts = walk.signals(df)
    got = found.toPandas()
    assert len(got) == n and facts["n_months"] >= 5 and set(got.signal_level) <= {"CONFIRM", "OBSERVE", "REJECT_AS_ONE_DAY_JUMP", "NONE"} and got.p_cal.notna().sum() > 500
    assert got[got.month == min(got.month)].p_raw.isna().all() and (got[got.quantile_switch].signal_level != "NONE").all()
    empty, why = walk.signals(df.where("month < '2019-02'"))
    assert why["reason"] == "insufficient_crossfit" and set(r[0] for r in empty.select("signal_level").distinct().collect()) == {"NONE"}
