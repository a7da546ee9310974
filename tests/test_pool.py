"""Pairs by blocks, Ward's tree and the pool's choice against plain Python."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from tapeline.operators import graph, clusters, pairs, pool


def panel(seed, codes, days):
    rng = np.random.default_rng(seed)
    common = rng.normal(0, 1, (3, days))
    rows = []
    for i in range(codes):
        r = common[i % 3] * (0.9 if i % 2 else 0.4) + rng.normal(0, 0.6, days)
        for d in range(days):
            if rng.random() > 0.15:
                rows.append((f"c{i:02d}", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=d), float(r[d])))
    return rows


def test_pairs_by_blocks(spark, monkeypatch):
    rows = panel(0, 13, 60) + [("flat", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=d), 0.5) for d in range(40)] + [("c00", pd.Timestamp("2020-01-01").date(), 99.0), ("lone", pd.Timestamp("2030-01-01").date(), 1.0), ("none", pd.Timestamp("2020-01-01").date(), None)]
    frame = pd.DataFrame(rows, columns=["code", "date", "ret"])
    df = spark.createDataFrame(rows, "code string, date date, ret double")
    wide = frame.dropna().groupby(["date", "code"]).ret.min().unstack()
    for block in (4, 256):  # many pairs of blocks, and one
        monkeypatch.setattr(pairs, "BLOCK", block)
        got = {(r["code_a"], r["code_b"]): r for r in pairs.pair_table(df, 20).collect()}
        assert set(got) == set(combinations(sorted(wide.columns), 2))
        for (a, b), r in got.items():
            both = wide[[a, b]].dropna()
            assert r["overlap"] == len(both)
            want = both[a].corr(both[b]) if len(both) >= 20 and both[a].std() > 0 and both[b].std() > 0 else 0.05
            assert math.isclose(r["corr"], want, abs_tol=1e-9)
    assert pairs.pair_table(df.limit(0)).count() == 0
    kept = pairs.subset(pairs.pair_table(df, 20), spark.createDataFrame([("c01",), ("c02",), ("c02",), ("zz",)], "code string")).collect()
    assert [(r["code_a"], r["code_b"]) for r in kept] == [("c01", "c02")]


def plain_ward(dist):
    """Heights by trying every pair at every step, from the variance that a merge adds."""
    groups = {i: [i] for i in range(len(dist))}
    d = {(i, j): dist[i, j] ** 2 for i, j in combinations(range(len(dist)), 2)}
    out = []
    while len(groups) > 1:
        (i, j), h = min(d.items(), key=lambda x: x[1])
        for k in groups:
            if k not in (i, j):
                a, b = d[min(i, k), max(i, k)], d[min(j, k), max(j, k)]
                ni, nj, nk = len(groups[i]), len(groups[j]), len(groups[k])
                d[min(i, k), max(i, k)] = ((nk + ni) * a + (nk + nj) * b - nk * h) / (ni + nj + nk)
        out.append((math.sqrt(h), sorted(groups[i] + groups[j])))
        groups[i] += groups.pop(j)
        d = {k: v for k, v in d.items() if j not in k}
    return out


def test_ward_and_cophenetic():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 24))
        x = rng.random((n, n))
        dist = (x + x.T) / 2
        np.fill_diagonal(dist, 0)
        merges, want = clusters.ward(dist), plain_ward(dist)
        members = {i: [i] for i in range(n)}
        far = np.zeros((n, n))
        for k, (a, b, h, size) in enumerate(merges):
            left, right = members[a], members[b]
            members[n + k] = sorted(left + right)
            assert size == len(members[n + k]) and math.isclose(h, want[k][0], rel_tol=1e-9) and members[n + k] == want[k][1]
            for i in left:
                for j in right:
                    far[i, j] = far[j, i] = h
        assert np.allclose(clusters.cophenetic(merges, n), far)


def test_clusters_by_panel(spark):
    rows = [("x", "a", "b", 0.95), ("x", "a", "c", 0.1), ("x", "b", "c", 0.2), ("y", "a", "b", 0.1), ("y", "a", "c", 0.99), ("y", "b", "c", 0.1)]
    df = spark.createDataFrame(rows, "panel string, code_a string, code_b string, corr double")
    got = {(r["panel"], r["code"]): r["cluster"] for r in clusters.ward_clusters(df, by=("panel",)).collect()}
    assert got == {("x", "a"): 1, ("x", "b"): 1, ("x", "c"): 2, ("y", "a"): 1, ("y", "b"): 2, ("y", "c"): 1}
    assert clusters.cophenetic_pairs(df, by=("panel",)).count() == 6


def scores(returns):
    """Half the rank of Sharpe, half that of momentum without the last 21 days."""
    wide = returns.pivot(index="date", columns="code", values="ret").sort_index()
    sharpe = (wide.mean() / wide.std(ddof=0).replace(0, np.nan) * math.sqrt(252)).fillna(0)
    momentum = ((wide.iloc[: len(wide) - min(21, len(wide) - 1)] + 1).prod() - 1).fillna(0)
    return 0.5 * sharpe.rank(pct=True) + 0.5 * momentum.rank(pct=True)


def quota(sizes, tops, target):
    """{cluster: cap} by adding one at a time."""
    total = sum(sizes.values())
    raw = {c: n / total * target for c, n in sizes.items()}
    cap = {c: max(1, min(math.ceil(raw[c]), n)) for c, n in sizes.items()}
    wanted = target + min(max(5, math.ceil(target * 0.15)), max(0, total - target))
    while sum(cap.values()) < wanted:
        room = [c for c in sizes if cap[c] < sizes[c]]
        if not room:
            break
        cap[min(room, key=lambda c: (-(raw[c] - math.floor(raw[c])), -sizes[c], -tops[c], c))] += 1
    return cap


def test_pool_selection(spark):
    rows = [(c, d, r / 50) for c, d, r in panel(3, 24, 230)]
    rows = [r for r in rows if not (r[0] in ("c05", "c11") and r[1].toordinal() % 3)]
    returns = pd.DataFrame(rows, columns=["code", "date", "ret"])
    df = spark.createDataFrame(rows, "code string, date date, ret double")
    table = pairs.pair_table(df, 30)
    corr = {frozenset((r["code_a"], r["code_b"])): r["corr"] for r in table.collect()}
    cluster = {f"c{i:02d}": i % 3 if i < 20 else i for i in range(24)}
    cl = spark.createDataFrame(list(cluster.items()), "code string, cluster int")
    target, days = 9, returns.groupby("code").size()
    ranked = pool.candidates(cl, df, target)
    stats = pool.cluster_stats(cl, table, df, df.withColumnRenamed("ret", "volume"))
    got = pool.select(ranked, stats, table, target).orderBy("place").collect()

    score, members = scores(returns), {}
    for c in sorted(set(cluster.values())):
        all_ = [k for k in cluster if cluster[k] == c]
        members[c] = [k for k in all_ if days[k] >= 180] or all_
    tops = {c: scores(returns[returns.code.isin(m)]) for c, m in members.items()}
    # a score among the members only is a rank over the same calendar
    caps = quota({c: len(m) for c, m in members.items()}, {c: t.max() for c, t in tops.items()}, target)
    order = {c: sorted(m, key=lambda k: (-round(score[k], 12), k)) for c, m in members.items()}
    rank = [(k, c, i + 1) for c, m in order.items() for i, k in enumerate(m[: caps[c]])]
    tried = sorted(rank, key=lambda x: (x[2] > 1, -round(score[x[0]], 12), x[1], x[2], x[0]))[:target]
    kept, why = [], {}

    def fits(k):
        return all(abs(corr[frozenset((k, o))]) <= (0.6 if cluster[o] == cluster[k] else 0.7) for o in kept)

    for k, c, r in tried:
        if fits(k):
            kept.append(k)
            why[k] = f"multi_rep_equal_cluster_{c}_rank_{r}" + ("_coverage" if r == 1 else "")
    mean = {c: (np.mean([corr[frozenset(p)] for p in combinations([k for k in cluster if cluster[k] == c], 2)]) if list(cluster.values()).count(c) > 1 else 1.0) for c in members}
    for c in sorted(members, key=lambda c: (-mean[c], -list(cluster.values()).count(c), c)):
        if c not in {cluster[k] for k in kept}:
            for i, k in enumerate(order[c]):
                if k not in {t[0] for t in tried} and fits(k):
                    kept.append(k)
                    why[k] = f"multi_rep_equal_cluster_{c}_rank_{i + 1}_coverage_rescue"
                    break
    assert [r["code"] for r in got] == kept
    assert all(r["reason"] == why[r["code"]] + ("_short_history" if days[r["code"]] < 180 else "") for r in got)


def test_quotas(spark):
    for seed in range(6):
        rng = random.Random(seed)
        sizes = {c: rng.randint(1, 12) for c in range(rng.randint(1, 9))}
        tops = {c: rng.choice([0.5, 0.7, 0.9]) for c in sizes}
        target = rng.randint(1, 30)
        df = spark.createDataFrame([(c, n, tops[c]) for c, n in sizes.items()], "cluster int, n long, top double")
        assert {r["cluster"]: r["cap"] for r in pool.quotas(df, target).collect()} == quota(sizes, tops, target)


def test_trim_goes_up_the_ladder(spark):
    corr = {("a", "b"): 0.9, ("a", "c"): 0.72, ("b", "c"): 0.1, ("a", "d"): 0.2, ("b", "d"): 0.74, ("c", "d"): 0.76}
    mean = {"a": 3.0, "b": 2.0, "c": 1.0, "d": 0.0}

    def trimmed(codes, target, corr=corr):
        rows = spark.createDataFrame([(c, mean[c]) for c in codes], "code string, mean double")
        pairs_ = spark.createDataFrame([(x, y, w) for (x, y), w in corr.items()], "code_a string, code_b string, corr double")
        return [r["code"] for r in pool.trimmed(rows, pairs_, target).orderBy("nth").collect()]

    assert trimmed("abcd", 2) == ["a", "d"]
    assert trimmed("abcd", 3) == ["a", "d", "c"]  # c only within 0.80
    assert trimmed("aabb", 2) == ["a", "b"] and trimmed("ab", 0) == ["a", "b"]
    assert trimmed("abc", 2, {("a", "b"): 0.9, ("a", "c"): 0.9, ("b", "c"): 0.9}) == ["a"]


def test_components_and_first_fit(spark):
    for seed, n, m in ((1, 60, 40), (2, 60, 120), (3, 40, 39)):
        rng = random.Random(seed)
        edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(n - 1)] if m == n - 1 else [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]
        names = [f"n{i:02d}" for i in range(n)]
        e = spark.createDataFrame(edges + [("n00", "elsewhere")], "a string, b string")
        near = {x: {b if a == x else a for a, b in edges if x in (a, b)} - {x} for x in names}
        want = {}
        for x in names:
            todo = [x]
            while todo:
                if (y := todo.pop()) not in want:
                    want[y] = x
                    todo += near[y]
        got = graph.components(spark.createDataFrame([(x,) for x in names], "id string"), e)
        assert {r["id"]: r["component"] for r in got.collect()} == want
        place = rng.sample(range(n), n)
        cluster, spare = [rng.randrange(12) for _ in names], [p > n * 0.6 for p in place]
        kept = []
        for i in sorted(range(n), key=place.__getitem__):
            if not near[names[i]] & {names[k] for k in kept} and not (spare[i] and cluster[i] in {cluster[k] for k in kept}):
                kept.append(i)
        nodes = spark.createDataFrame(list(zip(names, place, cluster, spare, strict=True)), "id string, place int, cluster int, spare boolean")
        assert {r["id"] for r in graph.first_fit(nodes, e).collect()} == {names[k] for k in kept}
    none = spark.createDataFrame([], "a string, b string")
    assert graph.components(nodes.limit(0), none).count() == 0 and graph.first_fit(nodes.limit(0), none).count() == 0 and graph.first_fit(nodes.withColumn("spare", F.lit(False)), none).count() == n
