"""Queries by name and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import other_sql
from ..operators import clusters, hmm, methods, scans
from ..operators.pairs import pair_table
from ..streaming import bars
from . import frame_queries, pool_queries, rule_queries, scan_oracles, scan_queries, signal_queries, source_queries, walk_queries
from .panel_sql import BARS, LABELS, SQL, STEP1
from .views import view_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: view_query(text) for name, text in SQL.items()}
ORACLE_SQL: dict[str, str] = {name: other_sql(text) for name, text in SQL.items()}


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_query(f"WITH {BARS},{STEP1},{LABELS} SELECT code, date, close, ma20, ma60, prior60, g1_raw, g2_raw FROM lab")(spark, sf_dir)


def p01_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(g):
        g["state"] = scans.hysteresis(g.g1_raw, g.close, g.ma20, g.ma60, 3)
        return g[["code", "date", "state"]]

    return scans.by_code(_labelled(spark, sf_dir), run, "code string, date date, state string")


def p02_stack_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(g):
        g["state"] = scans.stack_hysteresis(g.g2_raw, g.close, g.ma20, g.ma60)
        return g[["code", "date", "state"]]

    return scans.by_code(_labelled(spark, sf_dir), run, "code string, date date, state string")


def p04_merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(g):
        g["state"] = scans.merge_short(scans.hysteresis(g.g1_raw, g.close, g.ma20, g.ma60, 3), 8)
        return g[["code", "date", "state"]]

    return scans.by_code(_labelled(spark, sf_dir), run, "code string, date date, state string")


def p08_sticky_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(g):
        g["state"] = scans.sticky_up(g.g1_raw, g.close, g.ma20)
        return g[["code", "date", "state"]]

    return scans.by_code(_labelled(spark, sf_dir), run, "code string, date date, state string")


def p07_truth_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-ahead labels of the bars from the cutoff on, known from all of them."""

    def run(g):
        import datetime

        first = datetime.date.fromisoformat(CUTOFF)
        part = methods.truth_between(g.close, g.date, first, g.date.max())
        return g[g.date >= first][["code", "date"]].assign(truth=part)

    return scans.by_code(view_query(f"WITH {BARS} SELECT code, date, close FROM bars")(spark, sf_dir), run, "code string, date date, truth string")


def m01_ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.ward_clusters(pair_table(pool_queries.recent(spark, sf_dir)))


#: Training ends before this day, and evaluation starts with it.
CUTOFF = "1997-01-01"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view_query(f"WITH {BARS},{STEP1},{LABELS} SELECT *, coalesce(adx14, 0) AS adx, coalesce(plus_di, 0) AS plus, coalesce(minus_di, 0) AS minus FROM lab")(spark, sf_dir)
    return rule_queries.quiet(rows).selectExpr(*methods.COLUMNS.split(", "))


def g07_method_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final labels of every method with its own parameters, a column each."""

    def run(g):
        for name in methods.METHODS:
            g[name] = methods.labels(g, name)
        return g[["code", "date", *methods.METHODS]]

    return scans.by_code(_series(spark, sf_dir), run, "code string, date date, " + ", ".join(f"{m} string" for m in methods.METHODS))


def _final(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def run(g):
            return g[["code", "date"]].assign(label=methods.labels(g, method))

        return scans.by_code(_series(spark, sf_dir), run, "code string, date date, label string")

    return query


#: Final labels, a query for each method.
QUERIES |= {f"g{k:02d}_final": _final(method) for k, method in enumerate(methods.METHODS, 1)}


#: Methods whose training scores are a query, and the queries of their labels.
SCORED = {method: f"g{k:02d}_final" for k, method in enumerate(methods.METHODS, 1) if k in (1, 4, 6)}


def p06_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(g):
        g["truth"] = methods.truth(g.close)
        return g[["code", "date", "truth"]]

    return scans.by_code(view_query(f"WITH {BARS} SELECT code, date, close FROM bars")(spark, sf_dir), run, "code string, date date, truth string")


def x32_scores_by_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training scores of three methods on all bars of each series, against the look-ahead labels."""

    def run(g):
        import pandas as pd

        close, true = g.close.to_numpy(float), methods.truth(g.close)
        return pd.DataFrame({"code": g.code[0], "method": list(SCORED), "score": [round(methods.score(methods.labels(g, m), close, true), 6) for m in SCORED]})

    return scans.by_code(_series(spark, sf_dir), run, "code string, method string, score double")


def g11_method_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(g):
        import datetime
        import json

        import pandas as pd

        method, params, score, flat, n = methods.trained(g, datetime.date.fromisoformat(CUTOFF))
        return pd.DataFrame({"code": g.code[:1], "method": method, "params": json.dumps(params), "score": round(score, 6), "flat_truth": flat, "train_bars": n})

    return scans.by_code(_series(spark, sf_dir), run, "code string, method string, params string, score double, flat_truth boolean, train_bars long")


def g13_out_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen method and the fixed one after the training bars."""

    def run(g):
        import datetime

        import pandas as pd

        start = datetime.date.fromisoformat(CUTOFF)
        method, params, *_ = methods.trained(g, start)
        own, fixed = methods.evaluated(g, method, params, start), methods.evaluated(g, methods.FIXED, {}, start)
        return pd.DataFrame({"code": g.code[:1], "method": method, "bars": own["bars"], "n_trades": own["n"], **{k: round(own[k], 5) for k in ("compound", "bh", "edge")}, "fixed_edge": round(fixed["edge"], 5), "clipped": own["clipped"]})

    return scans.by_code(_series(spark, sf_dir), run, "code string, method string, bars long, n_trades long, compound double, bh double, edge double, fixed_edge double, clipped boolean")


RETURNS = f"WITH {BARS} SELECT code, date, ln(close / lag(close) OVER (PARTITION BY code ORDER BY date)) AS r FROM bars"
WINDOW = 252


def m09_hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three states fitted to the last 252 returns of each series, one row a state in order of deviation."""

    def run(g):
        import pandas as pd

        m = hmm.fit(g.r.to_numpy()[-WINDOW:])
        return pd.DataFrame({"code": g.code[0], "state": range(len(m.mu)), "mu": m.mu.round(6), "sigma": m.sigma.round(6), "stay": m.trans.diagonal().round(6), "separated": m.separation >= hmm.SEPARATED, "reliable": m.reliable})

    return scans.by_code(view_query(RETURNS)(spark, sf_dir), run, "code string, state int, mu double, sigma double, stay double, separated boolean, reliable boolean")


def p17_filtered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the states at each bar after the 252 returns to which the model is fitted."""

    def run(g):
        import pandas as pd

        r = g.r.to_numpy()[1:]
        m = hmm.fit(r[:WINDOW])
        later = g.iloc[1 + WINDOW :]
        if not m.reliable or not len(later):
            return pd.DataFrame({"code": [], "date": [], "calm": [], "middle": [], "wild": []})
        w = hmm.filtered(r, m)[WINDOW:].round(6)
        return pd.DataFrame({"code": later.code, "date": later.date, "calm": w[:, 0], "middle": w[:, 1], "wild": w[:, 2]})

    return scans.by_code(view_query(RETURNS)(spark, sf_dir), run, "code string, date date, calm double, middle double, wild double")


def x20_next_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named states of the last 252 returns: weight at the next bar, and the chance that reversal lasts 5, 10 and 20 bars."""

    def run(g):
        import pandas as pd

        r = g.r.to_numpy()[-WINDOW:]
        m = hmm.fit(r)
        if not m.reliable:
            return pd.DataFrame({"code": [], "state": [], "weight": [], "stay5": [], "stay10": [], "stay20": []})
        m = hmm.named(m)
        stay = hmm.stays(m)
        return pd.DataFrame({"code": g.code[0], "state": hmm.NAMES, "weight": hmm.ahead(hmm.filtered(r, m)[-1], m.trans)[0].round(6), **{f"stay{h}": round(p, 6) for h, p in stay.items()}})

    return scans.by_code(view_query(RETURNS)(spark, sf_dir), run, "code string, state string, weight double, stay5 double, stay10 double, stay20 double")


def t09_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.event_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))


def t08_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


ORACLE_SQL |= {
    "t09_event_bars": """SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "t08_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS edge FROM events),
s AS (SELECT user_id, ts, sum(edge) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, count(*) AS n FROM s GROUP BY user_id, k""",
}

QUERIES |= {f.__name__: f for f in (p01_hysteresis, p02_stack_hysteresis, p04_merge_short, p07_truth_slice, p08_sticky_up, m01_ward_clusters, g07_method_labels, p06_truth, x32_scores_by_truth, g11_method_choice, g13_out_of_sample, m09_hidden_states, p17_filtered_states, x20_next_states, t09_event_bars, t08_sessions)}


for part in (rule_queries, scan_queries, walk_queries, signal_queries, source_queries, frame_queries, pool_queries):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL

ORACLE_SQL |= scan_oracles.ORACLE_SQL
#: The labels of all methods side by side are those of the queries of each.
_FINAL = {method: f"g{k:02d}_final" for k, method in enumerate(methods.METHODS, 1)}
ORACLE_SQL["g07_method_labels"] = f"SELECT * FROM {' JOIN '.join(f'(SELECT code, date, label AS {method} FROM ({ORACLE_SQL[name]}) x) {name}' + (' USING (code, date)' if k else '') for k, (method, name) in enumerate(_FINAL.items()))}"
ORACLE_SQL["x32_scores_by_truth"] = " UNION ALL ".join(f"({scan_oracles.train_score(method, ORACLE_SQL[labels])})" for method, labels in SCORED.items())


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["p09_hold_up"](spark, sf_dir)
