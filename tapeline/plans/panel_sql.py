"""Queries over bars and panels as SQL texts, by the identifiers of the survey's inventory."""

from __future__ import annotations

from ..functions.features import LABELS, ORDER, RAIL_BARS, RAILS, SEEN, STEP1, TRADES, frame, islands, roll, smoothed
from ..sources.adapters import BARS, PANEL
from .views import PAIRS

SQL: dict[str, str] = {}


def put(name: str, *views: str, select: str) -> None:
    SQL[name] = "WITH " + ",".join(v for v in views) + "\n" + select


#: Dirty bars: a date that can't be read, a missing close, repeated dates of which the first counts, one long gap.
DIRTY = f"""
raw AS (SELECT code, CAST(date AS VARCHAR(20)) AS date, CAST(close AS VARCHAR(40)) AS close, volume, 1 AS place FROM bars
  UNION ALL SELECT code, CAST(date AS VARCHAR(20)), CAST(close * 2 AS VARCHAR(40)), volume, 2 FROM bars WHERE extract(day FROM date) <= 5
  UNION ALL SELECT code, 'not a date', CAST(close AS VARCHAR(40)), volume, 3 FROM bars WHERE extract(day FROM date) = 7
  UNION ALL SELECT code, CAST(date AS VARCHAR(20)), 'n/a', volume, 0 FROM bars WHERE extract(day FROM date) = 9),
typed AS (SELECT code, try_cast(date AS DATE) AS date, try_cast(close AS DOUBLE) AS close, volume, place FROM raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY place) AS nth FROM typed WHERE date IS NOT NULL AND close IS NOT NULL),
cleaned AS (SELECT code, date, close, volume FROM ranked WHERE nth = 1)"""
GAPPED = f"""
gapped AS (SELECT * FROM bars WHERE NOT (date BETWEEN DATE '1996-03-01' AND DATE '1996-05-15')),
steps AS (SELECT *, @DAYS(date, lag(date) OVER ({ORDER})) AS gap FROM gapped),
resumed AS (SELECT *, coalesce(max(CASE WHEN gap > 30 THEN date END) OVER (PARTITION BY code), min(date) OVER (PARTITION BY code)) AS resume FROM steps)"""

put("f01_clean_bars", BARS, DIRTY, select="SELECT code, date, round(close, 4) AS close, volume FROM cleaned")
put("f03_resume_after_gap", BARS, GAPPED, select="SELECT code, resume, count(*) AS bars, CAST(sum(CASE WHEN date >= resume THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM resumed GROUP BY code, resume")
put("f02_session_filter", BARS, GAPPED, select="SELECT code, date, round(close, 4) AS close FROM resumed WHERE close > 0 AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND date >= resume")
put("f04_latest_stretch", BARS, GAPPED, select="SELECT code, date, round(CASE WHEN date >= resume THEN close END, 4) AS close FROM resumed")
put("f07_log_returns", BARS, f"""
t AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM bars),
l AS (SELECT code, date, ln(close / lag(close) OVER ({ORDER})) AS r FROM t WHERE back <= 253 AND close > 0)""", select="SELECT code, date, round(r, 6) AS r FROM l WHERE r IS NOT NULL")
put("f08_split_guard", BARS, f"l AS (SELECT code, date, ln(close / lag(close) OVER ({ORDER})) AS r FROM bars)", select="SELECT code, date, round(r, 6) AS r FROM l WHERE abs(r) <= 0.25")
put("f09_eligibility", BARS, f"e AS (SELECT code, date, count(close) OVER ({SEEN}) AS seen, count(close) OVER ({frame(20)}) AS recent FROM bars)", select="SELECT code, date, seen >= 60 AND recent >= 18 AS eligible FROM e")
put("s07_range_scan", BARS, select="SELECT code, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
put("u01_upsert_bars", BARS, """
incoming AS (SELECT code, date, close * 1.01 AS close, extract(day FROM date) % 2 = 0 AS forced FROM bars WHERE extract(month FROM date) = 6
  UNION ALL SELECT code, @PLUS_DAYS(max(date), 1), max(close), false FROM bars GROUP BY code
  UNION ALL SELECT code, @PLUS_DAYS(max(date), 2), CAST(NULL AS DOUBLE), false FROM bars GROUP BY code),
judged AS (SELECT i.code, i.date, i.close, b.close AS old, CASE WHEN i.close IS NULL THEN 'skip' WHEN b.code IS NULL THEN 'written' WHEN i.forced THEN 'written' ELSE 'exists' END AS status
  FROM incoming i LEFT JOIN bars b ON i.code = b.code AND i.date = b.date)""", select="SELECT code, date, status, round(CASE WHEN status = 'written' THEN close ELSE old END, 4) AS close FROM judged")
put("s04_snapshot_scan", BARS, """
known AS (SELECT DISTINCT code FROM bars), latest AS (SELECT code, max(date) AS date FROM bars GROUP BY code),
snap AS (SELECT code, date FROM latest WHERE code <> 'x' UNION ALL SELECT 'unknown', DATE '1998-01-01')""", select="SELECT s.code, s.date, k.code IS NOT NULL AS is_known FROM snap s LEFT JOIN known k ON s.code = k.code")

FEATURES = ("ma5", "ma10", "ma20", "ma60", "prior20", "prior60", "roll_hi60", "roll_lo60", "band60", "atr20", "rv20", "adx14", "plus_di", "minus_di")


def rounded(*columns: str, digits: int = 5) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


put("w01_moving_averages", BARS, STEP1, select=f"SELECT code, date, {rounded('ma5', 'ma10', 'ma20', 'ma60', digits=4)} FROM feat")
put("w02_ratio_returns", BARS, STEP1, select=f"SELECT code, date, {rounded('prior20', 'prior60', 'ret1')} FROM feat")
put("w03_ranges", BARS, STEP1, select=f"SELECT code, date, {rounded('roll_hi60', 'roll_lo60', 'hi20', 'lo20', digits=4)}, {rounded('band60')} FROM feat")
put("w04_true_range", BARS, STEP1, select=f"SELECT code, date, round(tr, 4) AS tr, {rounded('atr20')} FROM feat")
put("w05_realised_vol", BARS, STEP1, f"""
v AS (SELECT *, ln(close / pc) AS lr FROM feat),
v2 AS (SELECT *, {roll("stddev_pop", "lr", 5, 5)} * sqrt(CAST(252 AS DOUBLE)) AS rv5, {roll("stddev_pop", "lr", 20, 20)} * sqrt(CAST(252 AS DOUBLE)) AS rv20p FROM v)""", select=f"SELECT code, date, {rounded('rv20', 'rv5', 'rv20p')} FROM v2")
put("w07_directional", BARS, STEP1, select=f"SELECT code, date, {rounded('plus_di', 'minus_di', 'adx14', digits=4)} FROM feat")
put("w08_crosses", BARS, STEP1, f"m AS (SELECT code, date, ma5, ma20, lag(ma5) OVER ({ORDER}) AS a, lag(ma20) OVER ({ORDER}) AS b FROM feat)", select="SELECT code, date, coalesce(ma5 > ma20 AND a <= b, false) AS golden, coalesce(ma5 < ma20 AND a >= b, false) AS death FROM m")
put("w09_range_position", BARS, STEP1, select="SELECT code, date, round((close - lo20) / nullif(hi20 - lo20, 0), 6) AS range_pos FROM feat")
put("w10_local_extrema", BARS, f"x AS (SELECT code, date, close, row_number() OVER ({ORDER}) AS rn, min(close) OVER ({frame(11)}) AS lo, max(close) OVER ({frame(11)}) AS hi FROM bars)", select="SELECT code, date, rn > 10 AND close = lo AS locmin, rn > 10 AND close = hi AS locmax FROM x")
put("w11_edges", BARS, STEP1, f"m AS (SELECT code, date, coalesce(close > ma20, false) AS m FROM feat), e AS (SELECT *, lag(m) OVER ({ORDER}) AS was FROM m)", select="SELECT code, date, m AND NOT coalesce(was, false) AS rising, NOT m AND coalesce(was, false) AS falling FROM e")
put("w13_segments", BARS, STEP1, LABELS, smoothed("lab", "g6_raw", 5, "s"), islands("s", "isl"), select="SELECT code, max(regime) AS regime, min(date) AS start_date, max(date) AS end_date, count(*) AS n_bars, round(max_by(close, date) / min_by(close, date) - 1, 6) AS ret FROM isl GROUP BY code, seg")
put("w14_fast_pattern", BARS, f"a AS (SELECT code, date, close / lag(close, 40) OVER ({ORDER}) - 1 AS r40 FROM bars), m AS (SELECT code, date, max(r40) OVER ({frame(60)}) AS top FROM a)", select="SELECT code, date, coalesce(top >= 0.2, false) AS fast FROM m")
put("w16_forward_fill", BARS, f"""
days AS (SELECT DISTINCT date FROM bars), codes AS (SELECT DISTINCT code FROM bars),
grid AS (SELECT c.code, d.date, b.close FROM codes c CROSS JOIN days d LEFT JOIN bars b ON b.code = c.code AND b.date = d.date),
filled AS (SELECT code, date, last_value(close) IGNORE NULLS OVER ({SEEN}) AS close FROM grid)""".replace("last_value(close) IGNORE NULLS OVER", "@LAST(close) OVER"), select="SELECT code, date, round(close, 4) AS close FROM filled")
put("w20_short_means", BARS, f"m AS (SELECT code, date, avg(close) OVER ({frame(8)}) AS m8, {roll('avg', 'close', 20, 20)} AS ma20 FROM bars)", select=f"SELECT code, date, {rounded('m8', 'ma20', digits=4)} FROM m")
put("w21_mode_smoothing", BARS, STEP1, LABELS, smoothed("lab", "g1_raw", 3, "s"), select="SELECT code, date, regime FROM s")
put("w23_return_z", BARS, STEP1, f"z AS (SELECT code, date, rn, ret1, stddev_samp(ret1) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS s, count(ret1) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM feat)", select="SELECT code, date, round(CASE WHEN n = 20 THEN ret1 / nullif(s, 0) END, 5) AS z FROM z")
FORWARD = f"""
y AS (SELECT code, date, close, ln(close) AS lc, ln(close / lag(close) OVER ({ORDER})) AS step FROM bars),
y2 AS (SELECT *, stddev_samp(step) OVER ({frame(20)}) AS sigma, count(step) OVER ({frame(20)}) AS ns, lead(lc, 10) OVER ({ORDER}) - lc AS r,
  sum(abs(step)) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path, min(lc) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) - lc AS mae, row_number() OVER ({ORDER}) AS rn FROM y),
labelled AS (SELECT code, date, rn, r, CASE WHEN r IS NULL OR ns < 18 OR sigma IS NULL THEN CAST(NULL AS BOOLEAN)
  ELSE r >= 0.35 * sigma * sqrt(CAST(10 AS DOUBLE)) AND abs(r) / nullif(path, 0) >= 0.28 AND mae >= -1 * sigma * sqrt(CAST(10 AS DOUBLE)) END AS label FROM y2)"""
put("w24_sigma20", BARS, FORWARD, select="SELECT code, date, round(CASE WHEN ns >= 18 THEN sigma END, 6) AS sigma FROM y2")
put("w25_forward_label", BARS, FORWARD, select="SELECT code, date, label, round(r, 6) AS r FROM labelled")
put("w26_event_clusters", BARS, FORWARD, f"""
pos AS (SELECT code, date, rn, CASE WHEN rn - lag(rn) OVER ({ORDER}) <= 5 THEN 0 ELSE 1 END AS edge FROM labelled WHERE label),
ev AS (SELECT *, sum(edge) OVER ({SEEN}) AS ev FROM pos)""", select="SELECT code, min(date) AS onset, max(date) AS event_end, count(*) AS n FROM ev GROUP BY code, ev")
put("w27_calendar", BARS, """
days AS (SELECT DISTINCT date FROM bars), m AS (SELECT @MONTH(date) AS month, count(*) AS n_days, min(date) AS first_day, max(date) AS last_day FROM days GROUP BY @MONTH(date))""", select="SELECT month, n_days, lag(last_day) OVER (ORDER BY month) AS train_end, last_day FROM m")
put("w28_drawdown", BARS, f"t AS (SELECT code, date, close / max(close) OVER ({SEEN}) - 1 AS dd FROM bars)", select="SELECT code, date, round(dd, 6) AS dd FROM t")
ANCHOR = f"""
anchor AS (SELECT date, exp(avg(ln(close))) AS close FROM bars GROUP BY date),
arv AS (SELECT date, stddev_pop(lr) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rva, count(lr) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS na
  FROM (SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS lr FROM anchor) t),
crv AS (SELECT code, date, close, {roll("stddev_pop", "lr", 20, 20)} AS rv, close / lag(close, 20) OVER ({ORDER}) - 1 AS r20, close / lag(close, 5) OVER ({ORDER}) - 1 AS r5 FROM (SELECT code, date, close, ln(close / lag(close) OVER ({ORDER})) AS lr FROM bars) t),
need AS (SELECT c.code, c.date, c.close, r20, r5, 0.043 * rv / nullif(rva, 0) AS need FROM crv c LEFT JOIN arv a ON a.date = c.date AND a.na = 20),
gaps AS (SELECT code, date, close, need, r20 - CASE WHEN need > -1 THEN power(1 + need, CAST(20 AS DOUBLE) / 252) - 1 END AS gap_20d, r5 - CASE WHEN need > -1 THEN power(1 + need, CAST(5 AS DOUBLE) / 252) - 1 END AS gap_5d FROM need)"""
put("w29_need_gap", BARS, ANCHOR, select=f"SELECT code, date, {rounded('need', 'gap_20d', 'gap_5d')} FROM gaps")

for k in range(1, 7):
    put(f"g{k:02d}_raw_labels", BARS, STEP1, LABELS, select=f"SELECT code, date, g{k}_raw AS label FROM lab")
put("g09_features", BARS, STEP1, select=f"SELECT code, date, {rounded(*FEATURES, digits=4)} FROM feat")
SLICE = (BARS, STEP1, LABELS, smoothed("lab", "g6_raw", 5, "s"), islands("s", "isl"), TRADES)
put("p09_hold_up", *SLICE, select="""
SELECT code, count(*) AS n_trades, CAST(sum(is_open) AS BIGINT) AS n_open, round(exp(sum(ln(exit_px / entry))) * power(CAST(0.999 AS DOUBLE), CAST(sum(2 - is_open) AS DOUBLE)) - 1, 5) AS compound,
  CAST(sum(CASE WHEN exit_px > entry THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM trades GROUP BY code""")
put("p09_trades", *SLICE, select="SELECT code, entry_date, exit_date, round(exit_px / entry - 1, 6) AS fwd_ret, is_open FROM trades")
put("p10_hold_up_compound", *SLICE, select="SELECT code, round(exp(sum(ln(exit_px / entry))) - 1, 5) AS compound FROM trades GROUP BY code")
put("p11_nav", *SLICE[:4], f"""
w AS (SELECT code, date, close, CASE WHEN regime = 'up' THEN 1 ELSE 0 END AS held FROM s),
n AS (SELECT *, coalesce(lag(held) OVER ({ORDER}), 0) AS was, lag(close) OVER ({ORDER}) AS pc FROM w),
g AS (SELECT code, date, (1 + was * coalesce(close / pc - 1, CAST(0 AS DOUBLE))) * (1 - CAST(0.001 AS DOUBLE) * abs(held - was)) AS f FROM n)""", select=f"SELECT code, date, round(exp(sum(ln(f)) OVER ({SEEN})), 5) AS nav FROM g")
put("a17_buy_hold_stats", *SLICE, """
bh AS (SELECT code, max_by(close, date) / min_by(close, date) - 1 AS bh FROM bars GROUP BY code),
st AS (SELECT code, exp(sum(ln(exit_px / entry))) - 1 AS compound, avg(CASE WHEN exit_px > entry THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS win FROM trades GROUP BY code)""", select="SELECT b.code, round(bh, 5) AS bh, round(compound, 5) AS compound, round(compound - bh, 5) AS edge, round(win, 6) AS win FROM bh b LEFT JOIN st ON st.code = b.code")
put("x32_train_score", *SLICE, f"""
b AS (SELECT l.code, l.date, l.g1_raw AS truth, s.regime, CASE WHEN s.regime <> lag(s.regime) OVER (PARTITION BY l.code ORDER BY l.date) THEN 1 ELSE 0 END AS sw FROM lab l JOIN s ON s.code = l.code AND s.date = l.date),
gain AS (SELECT code, exp(sum(ln(exit_px / entry))) - 1 AS hold FROM trades GROUP BY code),
one AS (SELECT b.code, CAST(sum(sw) AS BIGINT) AS switches, avg(CASE WHEN truth = regime THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS agree, avg(CASE WHEN regime = 'up' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS upfrac FROM b GROUP BY b.code)""",
    select="SELECT one.code, switches, round(agree, 6) AS agree, round(upfrac, 6) AS upfrac, round(coalesce(hold, CAST(0 AS DOUBLE)), 5) AS hold, round(0.45 * coalesce(hold, CAST(0 AS DOUBLE)) + 0.25 * agree + 0.15 * upfrac - 0.015 * switches, 5) AS score FROM one LEFT JOIN gain ON gain.code = one.code")

put("w17_trailing_trend", BARS, RAILS, select=f"SELECT code, date, {rounded(*[f'fig{p}_path' for p in RAIL_BARS], digits=3)}, {', '.join(f'round(ln(1 + fig{p}_g), 5) AS fig{p}_lg' for p in RAIL_BARS)} FROM rails")
put("w18_envelope", BARS, RAILS, select=f"SELECT code, date, {rounded(*[f'fig{p}_upper' for p in RAIL_BARS], *[f'fig{p}_lower' for p in RAIL_BARS], digits=3)} FROM rails")
POSITION = "\npos AS (SELECT *, ln(close / fig9_lower) / nullif(ln(fig9_upper / fig9_lower), 0) AS fig9_pos, ln(close / fig10_lower) / nullif(ln(fig10_upper / fig10_lower), 0) AS fig10_pos FROM rails)"
put("w19_band_position", BARS, RAILS, POSITION, select="SELECT code, date, round(fig9_pos, 3) + CAST(0 AS DOUBLE) AS fig9_pos, round(fig10_pos, 3) + CAST(0 AS DOUBLE) AS fig10_pos FROM pos")
put("w15_band_change", BARS, RAILS, POSITION, select="SELECT code, date, round(fig9_pos - lag(fig9_pos, 10) OVER (PARTITION BY code ORDER BY date), 3) + CAST(0 AS DOUBLE) AS fig9_pos_10 FROM pos")
STATES = f"""
low AS (SELECT *, CASE WHEN round(close - fig9_path, 7) < 0 THEN 0 ELSE 1 END AS off FROM rails),
low2 AS (SELECT *, sum(off) OVER ({SEEN}) AS isl FROM low),
low3 AS (SELECT *, sum(1 - off) OVER (PARTITION BY code, isl ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM low2),
st AS (SELECT *, CASE WHEN fig8_g IS NULL OR fig9_g IS NULL OR fig10_g IS NULL OR fig9_upper IS NULL THEN 'warm-up' WHEN round(close - fig9_upper, 7) >= 0 OR round(close - fig10_upper, 7) >= 0 THEN 'overheat'
  WHEN run >= 10 THEN 'knife' WHEN fig10_g <= 0 AND fig9_g <= 0 THEN 'down' WHEN fig8_g > 0 AND fig9_g > 0 THEN 'up' WHEN round(close - fig10_path, 7) >= 0 THEN 'repair' ELSE 'chop' END AS state FROM low3)"""
put("w12_run_below_path", BARS, RAILS, STATES, select="SELECT code, date, CAST(run AS BIGINT) AS run FROM low3")
put("x26_six_states", BARS, RAILS, STATES, select="SELECT code, date, state FROM st")
put("a18_max_drawdown", BARS, f"t AS (SELECT code, close / max(close) OVER ({SEEN}) - 1 AS dd FROM bars)", select="SELECT code, round(min(dd), 6) AS mdd FROM t GROUP BY code")
put("a19_cagr_calmar", BARS, f"t AS (SELECT code, date, close, close / max(close) OVER ({SEEN}) - 1 AS dd FROM bars), a AS (SELECT code, power(max_by(close, date) / min_by(close, date), CAST(250 AS DOUBLE) / count(*)) - 1 AS cagr, min(dd) AS mdd FROM t GROUP BY code)", select="SELECT code, round(cagr, 6) AS cagr, round(cagr / nullif(abs(mdd), 0), 5) AS calmar FROM a")

RECENT = """
days AS (SELECT date, dense_rank() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM panel) t),
recent AS (SELECT p.code, p.date, p.ret, p.volume FROM panel p JOIN days d ON d.date = p.date WHERE d.back <= 252)"""
ALL_PAIRS, RECENT_PAIRS = PAIRS.replace("__P__", "panel"), PAIRS.replace("__P__", "recent")
put("f05_recent_window", PANEL, RECENT, select="SELECT code, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM recent GROUP BY code")
put("f06_returns_prep", PANEL, RECENT, "grid AS (SELECT c.code, d.date, r.ret FROM (SELECT DISTINCT code FROM recent) c CROSS JOIN (SELECT DISTINCT date FROM recent) d LEFT JOIN recent r ON r.code = c.code AND r.date = d.date), filled AS (SELECT code, date, coalesce(ret, avg(ret) OVER (PARTITION BY code)) AS ret, var_samp(ret) OVER (PARTITION BY code) AS v FROM grid)", select="SELECT code, date, round(ret, 6) AS ret FROM filled WHERE v > 0")
put("a01_pair_overlap", PANEL, ALL_PAIRS, select="SELECT code_a, code_b, overlap FROM corr")
put("a02_pair_corr", PANEL, ALL_PAIRS, select="SELECT code_a, code_b, round(corr, 6) AS corr, round(1 - corr, 6) AS dist FROM corr")
put("a03_overlap_summary", PANEL, ALL_PAIRS, select="SELECT code, min(overlap) AS lo, @QUANTILE(CAST(overlap AS DOUBLE), 0.5) AS mid, max(overlap) AS hi FROM both_ways WHERE overlap > 0 GROUP BY code")
SCORES = """
nth AS (SELECT r.code, r.date, r.ret, d.back, nd.n FROM recent r JOIN days d ON d.date = r.date CROSS JOIN (SELECT count(DISTINCT date) AS n FROM recent) nd),
sm AS (SELECT code, coalesce(avg(ret) / nullif(stddev_pop(ret), 0), CAST(0 AS DOUBLE)) * sqrt(CAST(252 AS DOUBLE)) AS sharpe, exp(sum(CASE WHEN back > least(21, n - 1) THEN ln(1 + ret) ELSE CAST(0 AS DOUBLE) END)) - 1 AS mom FROM nth GROUP BY code),
rk AS (SELECT code, sharpe, mom, (rank() OVER (ORDER BY sharpe) + (count(*) OVER (PARTITION BY sharpe) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS rs, (rank() OVER (ORDER BY mom) + (count(*) OVER (PARTITION BY mom) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER () AS rm FROM sm),
scores AS (SELECT code, 0.5 * rs + 0.5 * rm AS score FROM rk)"""
put("a05_scores", PANEL, RECENT, SCORES, select="SELECT code, round(score, 6) AS score FROM scores")
put("a06_percent_rank", PANEL, RECENT, SCORES, select="SELECT code, round(rs, 6) AS rank_sharpe, round(rm, 6) AS rank_momentum FROM rk")
#: Clusters here are the panel's groups; medoids, representatives and quotas follow from them.
CLUSTER = "cl AS (SELECT DISTINCT code, CAST(substr(code, 7) AS INT) % 4 AS cluster FROM panel)"
put("a07_cluster_stats", PANEL, RECENT, RECENT_PAIRS, CLUSTER, """
pc AS (SELECT a.cluster, avg(c.corr) AS mean_corr FROM corr c JOIN cl a ON a.code = c.code_a JOIN cl b ON b.code = c.code_b AND b.cluster = a.cluster GROUP BY a.cluster),
one AS (SELECT r.code, cl.cluster, stddev_samp(ret) AS s, avg(ret) AS m, avg(volume) AS v, count(*) AS n FROM recent r JOIN cl ON cl.code = r.code GROUP BY r.code, cl.cluster),
agg AS (SELECT cluster, count(*) AS n, avg(s) AS mean_std, avg(m) AS mean_ret, avg(v) AS mean_volume, min(n) AS min_history FROM one GROUP BY cluster)""", select="SELECT agg.cluster, n, round(coalesce(mean_corr, CAST(1 AS DOUBLE)), 6) AS mean_corr, round(mean_std, 6) AS mean_std, round(mean_ret, 6) AS mean_ret, round(mean_volume, 4) AS mean_volume, min_history FROM agg LEFT JOIN pc ON pc.cluster = agg.cluster")
put("a08_quota", PANEL, RECENT, SCORES, CLUSTER, """
q AS (SELECT cluster, count(*) AS n, max(round(score, 9)) AS top FROM cl JOIN scores s ON s.code = cl.code GROUP BY cluster),
q2 AS (SELECT *, CAST(10 AS DOUBLE) * n / sum(n) OVER () AS raw, sum(n) OVER () AS total FROM q),
q3 AS (SELECT *, greatest(1, least(CAST(ceil(raw) AS INT), CAST(n AS INT))) AS cap, raw - floor(raw) AS rem FROM q2),
q4 AS (SELECT *, greatest(0, 10 + least(5, CAST(greatest(0, total - 10) AS INT)) - CAST(sum(cap) OVER () AS INT)) AS need,
  coalesce(sum(n - cap) OVER (ORDER BY round(rem, 9) DESC, n DESC, top DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q3)""", select="SELECT cluster, n, CAST(cap + least(n - cap, greatest(0, need - before)) AS BIGINT) AS quota FROM q4")
put("a09_volume_rank", PANEL, RECENT, CLUSTER, "v AS (SELECT cl.cluster, r.code, sum(volume) / count(*) AS v FROM recent r JOIN cl ON cl.code = r.code GROUP BY cl.cluster, r.code)", select="SELECT cluster, code, rank() OVER (PARTITION BY cluster ORDER BY round(v, 6) DESC) AS volume_rank FROM v")
TRAIL = "tr AS (SELECT r.code, cl.cluster, exp(sum(CASE WHEN d.back <= 20 THEN ln(1 + r.ret) ELSE CAST(0 AS DOUBLE) END)) - 1 AS ret20 FROM recent r JOIN days d ON d.date = r.date JOIN cl ON cl.code = r.code GROUP BY r.code, cl.cluster), sel AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY code) = 1 AND cluster <> 3 AS selected FROM tr)"
put("a10_trailing_return", PANEL, RECENT, CLUSTER, TRAIL, select="SELECT code, round(ret20, 6) AS ret20 FROM tr")
put("a11_missed_clusters", PANEL, RECENT, CLUSTER, TRAIL, select="SELECT cluster, count(*) AS n, max_by(code, round(ret20, 9)) AS best_code, round(max(ret20), 6) AS best_ret FROM sel GROUP BY cluster HAVING NOT bool_or(selected) AND count(*) >= 2")
put("a12_rep_lag", PANEL, RECENT, CLUSTER, TRAIL, "w AS (SELECT *, max(ret20) OVER (PARTITION BY cluster) - ret20 AS regret, rank() OVER (PARTITION BY cluster ORDER BY round(ret20, 9) DESC) AS rnk FROM sel)", select="SELECT cluster, code, CAST(rnk AS INT) AS rnk, round(regret, 6) AS regret FROM w WHERE selected AND rnk > 1 AND regret >= 0.01")
put("a13_cluster_members", PANEL, CLUSTER, select="SELECT cluster, @JOIN_SORTED(code) AS members FROM cl GROUP BY cluster")
put("m03_medoid", PANEL, RECENT, RECENT_PAIRS, CLUSTER, """
mc AS (SELECT a.cluster, w.code, round(avg(w.corr), 9) AS m FROM both_ways w JOIN cl a ON a.code = w.code JOIN cl b ON b.code = w.peer AND b.cluster = a.cluster GROUP BY a.cluster, w.code),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY m DESC, code) AS rn FROM mc)""", select="SELECT cluster, code, round(m, 6) AS mean_corr FROM o WHERE rn = 1")
put("m04_cluster_reps", PANEL, RECENT, CLUSTER, TRAIL, "mv AS (SELECT *, CASE WHEN ret20 >= 0.05 THEN 'up' WHEN ret20 <= -0.05 THEN 'down' ELSE 'flat' END AS direction, row_number() OVER (PARTITION BY cluster ORDER BY round(abs(ret20), 9) DESC, code) AS extreme FROM tr)", select="SELECT cluster, code, direction, round(ret20 * 100, 4) AS ret20_pct, extreme = 1 AND abs(ret20) >= 0.05 AS is_extreme_mover FROM mv")
put("o04_top_per_group", PANEL, RECENT, SCORES, CLUSTER, "t AS (SELECT cl.cluster, s.code, s.score, row_number() OVER (PARTITION BY cl.cluster ORDER BY round(s.score, 9) DESC, s.code) AS rn FROM scores s JOIN cl ON cl.code = s.code)", select="SELECT cluster, code, round(score, 6) AS score, CAST(rn AS INT) AS rn FROM t WHERE rn <= 3")
put("x13_rank_weight", PANEL, RECENT, SCORES, CLUSTER, "t AS (SELECT cl.cluster, s.code, s.score, row_number() OVER (PARTITION BY cl.cluster ORDER BY round(s.score, 9) DESC, s.code) AS rn FROM scores s JOIN cl ON cl.code = s.code)", select="SELECT code, round(score * power(CAST(0.65 AS DOUBLE), CAST(rn - 1 AS DOUBLE)), 6) AS w_exp, round(score / rn, 6) AS w_harmonic FROM t")
put("j06_semi_anti", PANEL, RECENT, CLUSTER, TRAIL, select="SELECT c.code, s.code IS NOT NULL AS is_selected FROM cl c LEFT JOIN (SELECT code FROM sel WHERE selected) s ON s.code = c.code")
put("j09_as_of", BARS, "ask AS (SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) t), days AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM bars) t)", select="SELECT a.o_orderkey, d.date AS as_of FROM ask a JOIN days d ON d.date <= a.o_orderdate AND (d.next_date > a.o_orderdate OR d.next_date IS NULL)")
Z5 = "z AS (SELECT code, date, ret1 / nullif(rv20 / sqrt(CAST(252 AS DOUBLE)), 0) AS z FROM feat), th AS (SELECT *, atan(z / sqrt(CAST(5 AS DOUBLE))) AS t FROM z), cdf AS (SELECT code, date, 0.5 + (t + sin(t) * (cos(t) + CAST(2 AS DOUBLE) / 3 * cos(t) * cos(t) * cos(t))) / pi() AS cdf FROM th)"
put("x18_student_cdf", BARS, STEP1, Z5, select="SELECT code, date, round(cdf, 6) AS cdf FROM cdf")
put("x19_quantile_switch", BARS, STEP1, Z5, select="SELECT code, date, CASE WHEN round(cdf, 9) >= 0.9 THEN 'up' WHEN round(cdf, 9) <= 0.1 THEN 'down' ELSE 'none' END AS side FROM cdf")
CALIB = (BARS, STEP1, Z5, FORWARD, "scored AS (SELECT l.code, l.date, CAST(round(c.cdf, 9) AS DOUBLE) AS p, CASE WHEN l.label THEN 1 ELSE 0 END AS y FROM labelled l JOIN cdf c ON c.code = l.code AND c.date = l.date WHERE l.label IS NOT NULL AND c.cdf IS NOT NULL)")
put("a14_calibration", *CALIB, "bins AS (SELECT CAST(floor(least(p * 10, CAST(9 AS DOUBLE))) AS INT) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS my, sum((p - y) * (p - y)) AS se FROM scored GROUP BY CAST(floor(least(p * 10, CAST(9 AS DOUBLE))) AS INT))", select="SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(se) / sum(n), 6) AS brier, round(sum(n * abs(my - mp)) / sum(n), 6) AS ece FROM bins")
put("m17_threshold_counts", *CALIB, "m AS (SELECT @MONTH(date) AS month, floor(p * 20) / 20 AS th, count(*) AS n, sum(y) AS hits FROM scored GROUP BY @MONTH(date), floor(p * 20) / 20)", select="SELECT month, CAST(th AS DOUBLE) AS th, CAST(sum(n) OVER (PARTITION BY month ORDER BY th DESC) AS BIGINT) AS n, CAST(sum(hits) OVER (PARTITION BY month ORDER BY th DESC) AS BIGINT) AS hits FROM m")
put("a16_coverage", *CALIB, select="SELECT code, round(avg(CASE WHEN p >= 0.9 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS switch_rate, round(avg(CAST(y AS DOUBLE)), 6) AS base_rate FROM scored GROUP BY code")
put("a21_value_counts", BARS, STEP1, LABELS, select="SELECT code, g4_raw AS label, count(*) AS n FROM lab GROUP BY code, g4_raw")
put("x01_code_digits", "c AS (SELECT c_custkey, c_name FROM customer)", select="SELECT c_custkey, CASE WHEN length(@DIGITS(c_name)) >= 6 THEN substr(@DIGITS(c_name), 1, 6) END AS code FROM c")
put("x10_business_day", BARS, "dd AS (SELECT DISTINCT date FROM bars)", select="SELECT date, CASE WHEN @WEEKDAY(date) = 1 THEN @PLUS_DAYS(date, -3) WHEN @WEEKDAY(date) = 7 THEN @PLUS_DAYS(date, -2) ELSE @PLUS_DAYS(date, -1) END AS previous FROM dd")
