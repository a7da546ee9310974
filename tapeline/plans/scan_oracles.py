"""State machines of the scans as recursive SQL of another engine, written from the rules: one step takes every series one
bar further."""

from __future__ import annotations

from ..functions.dialect import other_sql
from ..functions.features import LABELS, STEP1
from ..sources.adapters import BARS

_LAB = "sq AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS i, close AS c, ma20 AS a, ma60 AS b, {raw} AS raw, coalesce(close > ma20, false) AS over_ FROM lab)"
_START = f"WITH RECURSIVE {BARS},{STEP1},{LABELS}"

_BARS = f"WITH RECURSIVE {BARS},{STEP1},{LABELS}"


def hysteresis(raw: str, n: int = 3) -> str:
    """View h (code, i, date, state): state, runs above and below the 20-bar average, peak, trough and guard, and what each
    bar makes of them."""
    return f"""{_LAB.format(raw=raw)},
h AS (SELECT code, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS date, 'range' AS state, CAST(0 AS BIGINT) AS up, CAST(0 AS BIGINT) AS dn, CAST(NULL AS DOUBLE) AS peak, CAST(NULL AS DOUBLE) AS trough, CAST(0 AS BIGINT) AS guard FROM (SELECT DISTINCT code FROM sq) s
UNION ALL
SELECT code, i, date, next_, up, dn, CASE next_ WHEN 'up' THEN CASE WHEN was = 'up' THEN pk ELSE c END END,
  CASE WHEN was = 'up' THEN CASE WHEN next_ = 'down' THEN c WHEN next_ = 'range' THEN NULL ELSE trough END WHEN was = 'down' THEN CASE WHEN next_ = 'up' THEN NULL ELSE tr END ELSE CASE WHEN next_ = 'up' THEN NULL WHEN next_ = 'down' THEN c ELSE trough END END,
  CASE WHEN was = 'down' AND next_ = 'range' THEN 3 WHEN next_ <> was THEN CASE WHEN was = 'up' AND next_ = 'range' THEN guard ELSE 0 END WHEN was = 'range' THEN gd ELSE guard END
FROM (SELECT *, CASE WHEN was = 'up' THEN CASE WHEN raw = 'down' AND (dn >= {n} OR coalesce(a < b, false)) THEN 'down' WHEN dn >= 2 OR c / pk - 1 <= -0.06 OR (raw = 'range' AND dn >= {n} + 1) THEN 'range' ELSE 'up' END
    WHEN was = 'down' THEN CASE WHEN raw = 'up' AND (up >= {n} OR coalesce(a > b, false)) THEN 'up' WHEN up >= 2 OR c / tr - 1 >= 0.04 OR (raw = 'range' AND up >= {n}) THEN 'range' ELSE 'down' END
    ELSE CASE WHEN raw = 'up' AND (up >= {n} OR coalesce(a > b, false)) THEN 'up' WHEN raw = 'down' AND (dn >= {n} OR coalesce(a < b, false)) AND NOT coalesce(c > trough, false) AND NOT (gd > 0 AND dn < greatest({n}, 3)) THEN 'down' ELSE 'range' END END AS next_
  FROM (SELECT s.*, h.state AS was, CASE WHEN s.over_ THEN h.up + 1 ELSE 0 END AS up, CASE WHEN s.over_ THEN 0 ELSE h.dn + 1 END AS dn, greatest(coalesce(h.peak, s.c), s.c) AS pk, least(coalesce(h.trough, s.c), s.c) AS tr, h.trough, h.guard, greatest(0, h.guard - 1) AS gd
    FROM h JOIN sq s ON s.code = h.code AND s.i = h.i + 1) x) y)"""


def stack(raw: str) -> str:
    """View h, on the order of the two averages."""
    return f"""{_LAB.format(raw=raw)},
h AS (SELECT code, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS date, 'range' AS state, CAST(0 AS BIGINT) AS bull, CAST(0 AS BIGINT) AS bear, CAST(0 AS BIGINT) AS up, CAST(0 AS BIGINT) AS dn, CAST(NULL AS DOUBLE) AS peak, CAST(NULL AS DOUBLE) AS trough FROM (SELECT DISTINCT code FROM sq) s
UNION ALL
SELECT code, i, date, next_, bull, bear, up, dn, CASE WHEN next_ = 'up' THEN CASE WHEN was = 'up' THEN pk ELSE c END END, CASE WHEN next_ = 'down' THEN CASE WHEN was = 'down' THEN tr ELSE c END END
FROM (SELECT *, CASE WHEN was = 'up' THEN CASE WHEN bear >= 3 THEN 'down' WHEN dn >= 3 OR c / pk - 1 <= -0.12 OR (raw = 'range' AND bear >= 3) THEN 'range' ELSE 'up' END
    WHEN was = 'down' THEN CASE WHEN bull >= 3 AND up >= 3 THEN 'up' WHEN up >= 3 OR c / tr - 1 >= 0.04 OR (raw = 'range' AND bull >= 3) THEN 'range' ELSE 'down' END
    ELSE CASE WHEN raw = 'up' AND bull >= 3 AND up >= 3 THEN 'up' WHEN raw = 'down' AND bear >= 3 AND dn >= 3 THEN 'down' ELSE 'range' END END AS next_
  FROM (SELECT s.*, h.state AS was, CASE WHEN s.a > s.b THEN h.bull + 1 ELSE 0 END AS bull, CASE WHEN s.a < s.b THEN h.bear + 1 ELSE 0 END AS bear, CASE WHEN s.over_ THEN h.up + 1 ELSE 0 END AS up, CASE WHEN s.over_ THEN 0 ELSE h.dn + 1 END AS dn,
      greatest(coalesce(h.peak, s.c), s.c) AS pk, least(coalesce(h.trough, s.c), s.c) AS tr FROM h JOIN sq s ON s.code = h.code AND s.i = h.i + 1) x) y)"""


P01, P02 = f"{_BARS},{hysteresis('g1_raw')}", f"{_BARS},{stack('g2_raw')}"
#: Bars below the average, peak, and bars that the guard still waits for.
P08 = f"""{_START},{_LAB.format(raw="g1_raw")},
u AS (SELECT code, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS date, 'range' AS state, CAST(0 AS BIGINT) AS below, CAST(0 AS BIGINT) AS guard, CAST(NULL AS DOUBLE) AS peak FROM (SELECT DISTINCT code FROM sq) s
UNION ALL
SELECT code, i, date, CASE WHEN raw <> 'up' THEN raw WHEN waits OR leaves THEN 'range' ELSE 'up' END, CASE WHEN raw <> 'up' OR waits OR leaves THEN 0 ELSE n END, CASE WHEN raw <> 'up' THEN 0 WHEN waits THEN guard - CASE WHEN c >= a THEN 1 ELSE 0 END WHEN leaves THEN 2 ELSE 0 END, CASE WHEN raw = 'up' AND NOT waits AND NOT leaves THEN pk END
FROM (SELECT *, NOT waits AND (n >= 3 OR (n >= 1 AND c / pk - 1 <= -0.18)) AS leaves
  FROM (SELECT s.*, u.guard, u.guard > 0 AS waits, CASE WHEN s.c < s.a THEN u.below + 1 ELSE 0 END AS n, greatest(coalesce(u.peak, s.c), s.c) AS pk FROM u JOIN sq s ON s.code = u.code AND s.i = u.i + 1) x) y)"""


def _merged(source: str, out: str, least: int = 8) -> str:
    """One pass over the runs of ``source`` (code, i, date, state): a short run that isn't range takes the label before it
    as rewritten, a short first one that of the run after it, and an only one becomes range."""
    return f"""
{out}_e AS (SELECT *, sum(CASE WHEN state = was THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY i) AS run FROM (SELECT *, lag(state) OVER (PARTITION BY code ORDER BY i) AS was FROM {source}) t),
{out}_r AS (SELECT code, run, any_value(state) AS state, count(*) < {least} AND any_value(state) <> 'range' AS short FROM {out}_e GROUP BY code, run),
{out}_n AS (SELECT *, lead(state) OVER (PARTITION BY code ORDER BY run) AS after_ FROM {out}_r),
{out}_w AS (SELECT code, run, CASE WHEN short THEN coalesce(after_, 'range') ELSE state END AS label FROM {out}_n WHERE run = 1
  UNION ALL SELECT n.code, n.run, CASE WHEN n.short THEN w.label ELSE n.state END FROM {out}_w w JOIN {out}_n n ON n.code = w.code AND n.run = w.run + 1),
{out} AS (SELECT e.code, e.i, e.date, w.label AS state FROM {out}_e e JOIN {out}_w w ON w.code = e.code AND w.run = e.run)"""


def _final(machine: str, k: int, demoted: str = "false") -> str:
    """Final labels: the machine's states (view h) smoothed over k bars, some demoted to range, as are bars of lasting low
    volatility; then short runs merged."""
    n = lambda x: f"sum(CASE WHEN h.state = '{x}' THEN 1 ELSE 0 END) OVER (PARTITION BY h.code ORDER BY h.i ROWS {k - 1} PRECEDING)"
    share = "CAST(len(list_filter(list(rv) OVER y, lambda x: x <= rv)) AS DOUBLE) / nullif(count(rv) OVER y, 0)"
    return f"""{_BARS},{machine},
qv AS (SELECT code, date, p20, p60, coalesce(adx14, 0) AS adx, close, ma20, round(rv20, 9) AS rv FROM lab),
ql AS (SELECT *, CASE WHEN rv IS NOT NULL AND count(rv) OVER y >= 60 AND {share} < 0.35 THEN 1 ELSE 0 END AS low FROM qv WINDOW y AS (PARTITION BY code ORDER BY date ROWS 251 PRECEDING)),
qq AS (SELECT *, sum(low) OVER (PARTITION BY code ORDER BY date ROWS 14 PRECEDING) >= 10 AND NOT (abs(p60) >= 0.12 OR abs(p20) >= 0.08) AS quiet FROM ql),
sn AS (SELECT h.code, h.i, h.date, {n('down')} AS nd, {n('range')} AS nr, {n('up')} AS nu FROM h WHERE h.i > 0),
sm3 AS (SELECT code, i, date, CASE WHEN nd >= nr AND nd >= nu THEN 'down' WHEN nr >= nu THEN 'range' ELSE 'up' END AS s FROM sn),
sf AS (SELECT sm3.code, i, sm3.date, CASE WHEN quiet OR {demoted} THEN 'range' ELSE s END AS state FROM sm3 JOIN qq ON qq.code = sm3.code AND qq.date = sm3.date),{_merged('sf', 'm1', 10)},{_merged('m1', 'm2', 10)}
SELECT code, date, state AS label FROM m2"""


_G6 = "h AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY date) AS i, date, g6_raw AS state FROM lab)"
_WEAK = "(adx < 15 AND NOT (abs(p60) >= 0.06 OR abs(p20) >= 0.04) AND NOT (s = 'up' AND coalesce(close > ma20, false) AND p20 >= 0.02))"
FINAL = {"g01_final": _final(hysteresis("g1_raw"), 3), "g02_final": _final(stack("g2_raw"), 3), "g03_final": _final(hysteresis("g3_raw"), 3), "g04_final": _final(stack("g4_raw"), 3), "g05_final": _final(hysteresis("g5_raw", 2), 3), "g06_final": _final(_G6, 5), "g07_final": _final(hysteresis("g1_raw"), 3, _WEAK)}

ORACLE_SQL = {name: other_sql(text) for name, text in {
    **FINAL,
    "p01_hysteresis": f"{P01} SELECT code, date, state FROM h WHERE i > 0",
    "p02_stack_hysteresis": f"{P02} SELECT code, date, state FROM h WHERE i > 0",
    "p08_sticky_up": f"{P08} SELECT code, date, state FROM u WHERE i > 0",
    "p04_merge_short": f"{P01}, h1 AS (SELECT code, i, date, state FROM h WHERE i > 0),{_merged('h1', 'm1')},{_merged('m1', 'm2')} SELECT code, date, state FROM m2",
}.items()}

#: Look-ahead labels: extremes of an 8-bar mean, one after the other, either move the pivot in hand, turn away from it or
#: are passed over; legs between pivots are labelled by their move, short ones take the label before.
_TRUTH = f"""WITH RECURSIVE {BARS},
tl AS (SELECT code, date, close, avg(close) OVER (PARTITION BY code ORDER BY date ROWS 7 PRECEDING) AS lv, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM bars),
tn AS (SELECT *, lag(lv) OVER (PARTITION BY code ORDER BY i) AS pl, lead(lv) OVER (PARTITION BY code ORDER BY i) AS nl FROM tl),
tx AS (SELECT code, i, lv, CASE WHEN lv >= pl AND lv >= nl THEN 'H' ELSE 'L' END AS kind, row_number() OVER (PARTITION BY code ORDER BY i) AS e FROM tn WHERE n >= 60 AND pl IS NOT NULL AND nl IS NOT NULL AND (lv >= greatest(pl, nl) OR lv <= least(pl, nl))),
tw AS (SELECT code, e, i AS pv, kind, lv, CAST(NULL AS BIGINT) AS pushed, CAST(NULL AS VARCHAR) AS pk FROM tx WHERE e = 1 UNION ALL
  SELECT code, e, CASE WHEN act > 0 THEN i ELSE pv END, CASE WHEN act > 0 THEN k2 ELSE kind END, CASE WHEN act > 0 THEN l2 ELSE lv END, CASE WHEN act = 2 THEN pv END, CASE WHEN act = 2 THEN kind END
  FROM (SELECT w.code, w.pv, w.kind, w.lv, x.e, x.i, x.kind AS k2, x.lv AS l2, CASE WHEN x.kind = w.kind THEN CASE WHEN (x.kind = 'H' AND x.lv >= w.lv) OR (x.kind = 'L' AND x.lv <= w.lv) THEN 1 ELSE 0 END WHEN x.i - w.pv >= 25 AND abs(x.lv - w.lv) / greatest(w.lv, 1e-8) >= 0.18 THEN 2 ELSE 0 END AS act FROM tw w JOIN tx x ON x.code = w.code AND x.e = w.e + 1) y),
tp AS (SELECT code, pushed AS i, pk AS kind FROM tw WHERE pushed IS NOT NULL UNION ALL SELECT code, arg_max(pv, e), arg_max(kind, e) FROM tw GROUP BY code UNION ALL SELECT DISTINCT code, 0, 'L' FROM tl WHERE n >= 60 AND code NOT IN (SELECT code FROM tx)),
te AS (SELECT * FROM tp UNION ALL SELECT code, 0, CASE WHEN arg_min(kind, i) = 'H' THEN 'L' ELSE 'H' END FROM tp GROUP BY code HAVING min(i) > 0
  UNION ALL SELECT p.code, any_value(t.n) - 1, CASE WHEN arg_max(p.kind, p.i) = 'H' THEN 'L' ELSE 'H' END FROM tp p JOIN (SELECT DISTINCT code, n FROM tl) t ON t.code = p.code GROUP BY p.code HAVING max(p.i) < any_value(t.n) - 1),
tg AS (SELECT code, i AS a, kind AS x, lead(i) OVER o AS b, lead(kind) OVER o AS y FROM te WINDOW o AS (PARTITION BY code ORDER BY i)),
tm AS (SELECT g.code, a, b, CASE WHEN x = 'L' AND y = 'H' AND cb.close / ca.close - 1 >= 0.22 THEN 'up' WHEN x = 'H' AND y = 'L' AND cb.close / ca.close - 1 <= -0.22 THEN 'down' ELSE 'range' END AS label FROM tg g JOIN tl ca ON ca.code = g.code AND ca.i = a JOIN tl cb ON cb.code = g.code AND cb.i = b WHERE b IS NOT NULL),
ti AS (SELECT *, sum(edge) OVER (PARTITION BY code ORDER BY a) AS k FROM (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY code ORDER BY a) THEN 0 ELSE 1 END AS edge FROM tm) z),
tj AS (SELECT code, k, min(a) AS a, max(b) AS b, any_value(label) AS label FROM ti GROUP BY code, k),
tk AS (SELECT code, a, last_value(CASE WHEN k = 1 OR b - a + 1 >= 30 THEN label END IGNORE NULLS) OVER (PARTITION BY code ORDER BY a ROWS UNBOUNDED PRECEDING) AS label FROM tj),
truth AS (SELECT t.code, t.date, coalesce((SELECT arg_max(k.label, k.a) FROM tk k WHERE k.code = t.code AND k.a <= t.i), 'range') AS truth FROM tl t)"""

ORACLE_SQL |= {
    "p06_truth": f"{_TRUTH} SELECT code, date, truth FROM truth",
    "p07_truth_slice": f"{_TRUTH} SELECT code, date, truth FROM truth WHERE date >= DATE '1997-01-01'",
}


def train_score(method: str, labels: str) -> str:
    """Gain of holding while up, agreement with the look-ahead labels, share of up, and turns, of a method's labels (SQL)."""
    return f"""WITH lb AS (SELECT l.code, l.date, l.label, t.truth, b.close, row_number() OVER (PARTITION BY l.code ORDER BY l.date) AS i, count(*) OVER (PARTITION BY l.code) AS n, last_value(b.close) OVER (PARTITION BY l.code ORDER BY l.date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM ({labels}) l JOIN ({ORACLE_SQL["p06_truth"]}) t ON t.code = l.code AND t.date = l.date JOIN (WITH {BARS} SELECT code, date, close FROM bars) b ON b.code = l.code AND b.date = l.date),
ed AS (SELECT *, coalesce(label <> lag(label) OVER (PARTITION BY code ORDER BY i), true) AS edge FROM lb), rn AS (SELECT *, lead(close) OVER (PARTITION BY code ORDER BY i) AS after FROM ed WHERE edge),
gn AS (SELECT code, sum(CASE WHEN label = 'up' THEN ln(coalesce(after, final) / close) ELSE 0 END) AS g, count(*) AS runs FROM rn GROUP BY code), sh AS (SELECT code, avg(CAST(label = truth AS INT)) AS same, avg(CAST(label = 'up' AS INT)) AS up FROM lb GROUP BY code)
SELECT gn.code, '{method}' AS method, round(0.45 * (exp(g) - 1) + 0.25 * same + 0.15 * up - 0.015 * (runs - 1), 6) AS score FROM gn JOIN sh ON sh.code = gn.code"""
