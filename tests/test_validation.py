"""Named states and summaries on hand-made cases."""

import numpy as np

from tapeline.operators import hmm, validation


def test_states_are_named():
    trans = np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.1, 0.6]])
    m = hmm.named(hmm.Model(np.full(3, 1 / 3), trans, np.array([0.01, -0.01, 0.0]), np.array([0.03, 0.02, 0.01])))
    assert list(m.mu) == [0.0, -0.01, 0.01] and m.trans[0, 0] == 0.6 and m.trans[1, 2] == 0.2
    tie = hmm.named(hmm.Model(np.full(3, 1 / 3), trans, np.zeros(3), np.array([0.03, 0.02, 0.01])))
    assert list(tie.sigma) == [0.01, 0.02, 0.03]
    assert np.allclose(hmm.ahead([2.0, 0, 0], trans), trans[0]) and not hmm.ahead(np.zeros(3), trans).any()
    assert hmm.stays(m)[10] == m.trans[2, 2] ** 10
    got = hmm.moved(np.full((3, 3), 1 / 9))
    assert np.isclose(got["switch"], 2 / 3) and np.isclose(got["into_reversal"], 2 / 9) and np.isclose(got["state_calm"], 1 / 3)


def test_summaries(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2)], "code string, n int")
    now = spark.createDataFrame([("b", 5, "x")], "code string, n int, note string")
    assert sorted(map(tuple, validation.merged(before, now).collect()), key=str) == [("a", 1, None), ("b", 5, "x")]
    assert validation.merged(before, now.limit(0)).count() == 2
    days = spark.createDataFrame([("2024-01-05",), (None,)], "as_of string")
    assert validation.already_scored(days, days, "2024-01-05") and not validation.already_scored(days, days.limit(0), "2024-01-05")


def test_buckets_hold_their_lower_edge():
    """At 250 returns both edges are returns themselves."""
    r = np.linspace(-1, 1, 250) ** 3 + 0.001
    size = np.sort(np.abs(r))
    edges = np.quantile(np.abs(r), [1 / 3, 2 / 3])
    assert np.isclose(edges, size[[83, 166]]).all()
    m = hmm.initial(r, 3)
    parts = [r[np.abs(r) < edges[0]], r[(np.abs(r) >= edges[0]) & (np.abs(r) < edges[1])], r[np.abs(r) >= edges[1]]]
    assert [len(p) for p in parts] == [83, 83, 84] and np.allclose(m.mu, [p.mean() for p in parts]) and np.allclose(m.sigma, [p.std(ddof=1) for p in parts])


def test_fits_of_many_series_are_those_of_each():
    rng = np.random.default_rng(7)
    series = [rng.standard_t(5, n) * np.where(np.arange(n) // 40 % 2, 0.03, 0.01) for n in (252, 100, 59, 61, 251, 0)] + [np.append(rng.normal(0, 0.01, 80), np.nan)]
    for many, r in zip(hmm.fit_all(series), series, strict=True):
        one = hmm.fit(r)
        assert many.reliable == one.reliable and many.rounds == one.rounds and all(np.allclose(getattr(many, x), getattr(one, x), atol=1e-9, equal_nan=True) for x in ("start", "trans", "mu", "sigma"))


def test_summaries_as_expressions(spark):
    from tapeline.operators import filtering

    rng = np.random.default_rng(9)
    trans = np.array([[0.9, 0.06, 0.04], [0.1, 0.8, 0.1], [0.05, 0.2, 0.75]])
    mu, sigma = np.array([0.0, -0.01, 0.02]), np.array([0.01, 0.02, 0.03])
    series = [rng.standard_t(3, n) * 0.02 for n in (2, 41, 300, 1, 0)]
    rows = spark.createDataFrame([(k, r.tolist(), trans.ravel().tolist(), mu.tolist(), sigma.tolist()) for k, r in enumerate(series)], "k int, returns array<double>, trans array<double>, mu array<double>, sigma array<double>")
    got = {r["k"]: r for r in filtering.with_summaries(rows).collect()}
    m = hmm.Model(np.full(3, 1 / 3), trans, mu, sigma, reliable=True)
    for k, r in enumerate(series[:3]):
        before = hmm.filtered(r, m)
        last = before[-2] if len(r) > 1 else m.start
        joint = last[:, None] * trans * np.exp(hmm.log_density(r[-1:], m, 5.0)[0])
        moved = hmm.moved(joint / joint.sum())
        assert np.isclose(got[k]["p_switch"], moved["switch"]) and np.isclose(got[k]["p_into_reversal"], moved["into_reversal"]) and np.allclose(got[k]["state"], before[-1]) and np.allclose(got[k]["next"], hmm.ahead(before[-1], trans)[0]) and np.isclose(got[k]["stay20"], hmm.stays(m)[20])
    assert all(got[k]["p_switch"] is None and got[k]["stay5"] is None for k in (3, 4))
