"""Queries of the rules on trend rails, and their SQL for another engine, written from the rules and apart from the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import other_sql
from ..functions.features import RAILS, STEP1
from ..operators import rails as rail_ops
from ..operators import rules
from ..sources.adapters import BARS
from .views import view_query

ANCHOR = "SELECT date, exp(avg(ln(close))) AS close FROM bars GROUP BY date"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_query(f"WITH {BARS} SELECT * FROM bars")(spark, sf_dir)


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rail_ops.rails(bars(spark, sf_dir)), view_query(f"WITH {BARS} {ANCHOR}")(spark, sf_dir)


def w06_hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view_query(f"WITH {BARS},{STEP1} SELECT code, date, round(rv20, 9) AS rv20 FROM feat")(spark, sf_dir)
    seen = F.count("rv20").over(rules.frame(120))
    return rail_ops.with_share(rows, "rv20", 120, "share").select("code", "date", F.round(F.when(seen >= 5, F.col("share")), 6).alias("pct"))


def quiet(rows: DataFrame) -> DataFrame:
    """``rows`` (code, date, rv20, p20, p60, ...) with quiet: volatility low on 10 of the last 15 bars, prices hardly moved."""
    low = F.when((F.count("rv9").over(rules.frame(252)) >= 60) & (F.col("share") < 0.35), 1).otherwise(0)
    shared = rail_ops.with_share(rows.withColumn("rv9", F.round("rv20", 9)), "rv9", 252, "share").withColumn("low", low)
    moved = (F.abs("p60") >= 0.12) | (F.abs("p20") >= 0.08)
    return shared.withColumn("quiet", (F.sum("low").over(rules.frame(15)) >= 10) & ~moved).drop("rv9", "share", "low")


def w22_low_vol_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view_query(f"WITH {BARS},{STEP1} SELECT code, date, rv20, p20, p60 FROM feat")(spark, sf_dir)
    return quiet(rows).select("code", "date", F.col("quiet").alias("ranged"))


def x27_mask_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.rule_frame(*parts(spark, sf_dir))
    sides = [c.alias(f"{v}_{side}") for v in rules.VARIANTS for side, c in zip(("buy", "sell"), rules.variant(v), strict=True)]
    return rows.select("code", "date", *sides)


def x28_rule_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.masks(rules.rule_frame(*parts(spark, sf_dir))).select("code", "date", "ae_buy", "ae_sell", "b1", "fast", "fig8_sell", "g1")


def x29_touch_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ("near_lo", "near_hi", "aux_buy", "aux_sell", "locmin", "locmax", "stretch")
    return rules.rule_frame(*parts(spark, sf_dir)).select("code", "date", *flags, *[(F.round(c, 4) + 0.0).alias(c) for c in ("gap_5d", "gap_20d", "fig9_pos", "vol5_pct")])


def a20_type_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.types(parts(spark, sf_dir)[0]).select("code", "bars", *[F.round(c, 5).alias(c) for c in ("vol", "total", "cagr", "mdd", "crossings")], "type")


def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rails, anchor = parts(spark, sf_dir)
    return rules.signals(rules.masks(rules.rule_frame(rails, anchor)), rules.types(rails), rules.specs(spark))


def x27_spec_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signalled(spark, sf_dir).select("code", "date", "type", "buy", "sell")


def x30_flat_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, status = rules.flat_quote()
    return signalled(spark, sf_dir).select("code", "date", F.round(price, 3).alias("quote"), status.alias("status"))


def p12_rule_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.machines(signalled(spark, sf_dir)).select("code", "trades", F.round("equity", 6).alias("equity"), "action", "holding", "latch", F.round("peak", 4).alias("peak"), F.round("stop", 4).alias("stop"), "trail_hit", "sell_masked")


READINGS = ("dist_lo9", "dist_hi9", "dist_hi8", "gap_5d", "gap_20d", "fig7_gap", "fig8_gap", "fig9_pos", "fig10_pos", "pos9_10", "run40", "vol5_pct")


def x31_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the last bar, what they trigger, the quote and the machine's action: the rule evaluation (P13)."""
    found = rules.evaluate(*parts(spark, sf_dir))
    return found.select("code", "date", "type", "action", "holding", *[(F.round(c, 4) + 0.0).alias(c) for c in READINGS], "near_lo_edge", "near_hi_edge", "sell_a", "prem_or_pos10", F.round("quote", 3).alias("quote"), "quote_status", "triggers")


def m24_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code's last buy stands for today's; the clusters are those of the first letter of the code."""
    rows = signalled(spark, sf_dir).where("buy").groupBy("code").agg(F.max_by(F.col("close") / F.col("fig9_lower") - 1, "date").alias("dist_lo9"))
    last = bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close", 20).over(rules.W()) - 1).groupBy("code").agg(F.max_by("ret", "date").alias("ret"))
    clusters = last.select("code", F.substring("code", 1, 1).alias("cluster"), F.col("code").like("%L").alias("is_representative"), F.round(F.col("ret") * 100, 4).alias("ret20_pct"))
    checked = last.select("code").join(rows, "code", "left").withColumn("action", F.when(F.col("dist_lo9").isNull(), "none").otherwise("buy"))
    return rules.recommended(checked, clusters.where("cluster <> 'E'")).select("code", "action", "cluster", "is_representative", F.round("ret20_pct", 4).alias("ret20_pct"), "recommend")


QUERIES = {f.__name__: f for f in (w06_hist_percentile, w22_low_vol_persistence, x27_mask_variants, x28_rule_masks, x29_touch_frame, a20_type_features, x27_spec_signals, x30_flat_quote, p12_rule_machine, x31_snapshot, m24_recommendations)}

# ---- the same rules as SQL

_F = lambda n: f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_O = "(PARTITION BY code ORDER BY date)"
_VOL = lambda x, n, by: f"CASE WHEN count({x}) OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN stddev_pop({x}) OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END * sqrt(252.0)"
_NEED = lambda rv, a, n: f"CASE WHEN 0.043 * {rv} / nullif({a}, 0) > -1 THEN pow(1 + 0.043 * {rv} / nullif({a}, 0), {n} / 252.0) - 1 END"

RULES_SQL = f"""
an AS ({ANCHOR}),
al AS (SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS lr FROM an),
av AS (SELECT date, {_VOL("lr", 5, "ORDER BY date")} AS a5, {_VOL("lr", 20, "ORDER BY date")} AS a20 FROM al),
bl AS (SELECT code, date, close, ln(close / lag(close) OVER {_O}) AS lr, close / lag(close, 5) OVER {_O} - 1 AS r5, close / lag(close, 20) OVER {_O} - 1 AS r20 FROM bars),
bv AS (SELECT *, {_VOL("lr", 5, "PARTITION BY code ORDER BY date")} AS rv5, {_VOL("lr", 20, "PARTITION BY code ORDER BY date")} AS rv20 FROM bl),
gp AS (SELECT bv.code, bv.date, rv5, r5 - {_NEED("rv5", "a5", 5)} AS gap_5d, r20 - {_NEED("rv20", "a20", 20)} AS gap_20d FROM bv LEFT JOIN av ON av.date = bv.date),
vp AS (SELECT *, CASE WHEN rv5 IS NOT NULL AND count(rv5) OVER {_F(120)} >= 5 THEN CAST(len(list_filter(list(rv5) OVER {_F(120)}, lambda x: x <= rv5)) AS DOUBLE) / count(rv5) OVER {_F(120)} END AS vol5_pct FROM gp),
rf AS (SELECT r.*, gap_5d, gap_20d, vol5_pct, CASE WHEN r.rn >= 5 THEN avg(r.close) OVER w5 END AS ma5, CASE WHEN r.rn >= 20 THEN avg(r.close) OVER w20 END AS ma20, ln(r.close / fig9_lower) / nullif(ln(fig9_upper / fig9_lower), 0) AS fig9_pos,
  ln(r.close / fig10_lower) / nullif(ln(fig10_upper / fig10_lower), 0) AS fig10_pos, coalesce(round(r.close - fig9_upper, 7) >= 0, false) AS th9, coalesce(round(r.close - fig10_upper, 7) >= 0, false) AS th10,
  r.rn > 10 AND r.close = min(r.close) OVER w11 AS locmin, r.rn > 10 AND r.close = max(r.close) OVER w11 AS locmax
  FROM rails r JOIN vp ON vp.code = r.code AND vp.date = r.date
  WINDOW w5 AS (PARTITION BY r.code ORDER BY r.date ROWS 4 PRECEDING), w20 AS (PARTITION BY r.code ORDER BY r.date ROWS 19 PRECEDING), w11 AS (PARTITION BY r.code ORDER BY r.date ROWS 10 PRECEDING)),
rg AS (SELECT *, coalesce(close <= fig9_lower * 1.01, false) AS near_lo, coalesce(close >= fig9_upper * 0.99, false) AS near_hi, coalesce(close >= fig8_upper * 0.99, false) AS near_hi8,
  coalesce(close < ma20 AND ma5 < ma20 AND gap_5d <= 0 AND gap_20d <= 0 AND NOT th10, false) AS aux_buy, coalesce(close > ma20 AND ma5 > ma20 AND gap_5d >= 0 AND gap_20d >= 0, false) AS aux_sell FROM rf),
rh AS (SELECT *, coalesce(aux_sell AND locmax AND vol5_pct >= 0.70 AND fig9_g > 0 AND NOT (th9 OR th10) AND fig9_pos >= 0.80 AND (fig7_gap >= 0.05 OR fig10_pos >= 0.90), false) AS stretch,
  coalesce(lag(near_lo) OVER {_O}, false) AS was_lo, coalesce(lag(near_hi) OVER {_O}, false) AS was_hi, close / lag(close, 40) OVER {_O} - 1 AS run, fig9_pos - lag(fig9_pos, 10) OVER {_O} AS pos9_10 FROM rg),
rm AS (SELECT *, near_lo AND NOT was_lo AND aux_buy AS ae_buy, (near_hi AND NOT was_hi AND aux_sell) OR stretch AS ae_sell, coalesce(fig7_gap <= -0.08 OR fig8_gap <= -0.08, false) AS disc_ok, max(run) OVER {_F(60)} AS run40,
  (near_hi8 AND aux_sell) OR stretch AS fig8_sell, coalesce(fig7_g > 0 AND fig8_g > 0 AND pos9_10 >= 0.30 AND fig9_pos >= 0.80 AND NOT th9 AND fig10_g > fig9_g, false) AS g1 FROM rh),
mk AS (SELECT *, disc_ok AND near_lo AS b1, coalesce(run40 >= 0.20, false) AS fast FROM rm)"""

TYPES_SQL = f"""
tq AS (SELECT code, date, close, close / lag(close) OVER {_O} - 1 AS r, close / max(close) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd, CASE WHEN close >= fig7_path THEN 1 ELSE 0 END AS above, fig7_path FROM rails),
tc AS (SELECT *, CASE WHEN above <> lag(above) OVER {_O} AND fig7_path IS NOT NULL THEN 1 ELSE 0 END AS crossed FROM tq),
tf AS (SELECT code, count(*) AS bars, stddev_samp(r) * sqrt(250.0) AS vol, max_by(close, date) / min_by(close, date) - 1 AS total, pow(max_by(close, date) / min_by(close, date), 250.0 / count(*)) - 1 AS cagr, min(dd) AS mdd, sum(crossed) / (count(*) / 250.0) AS crossings FROM tc GROUP BY code),
ty AS (SELECT *, CASE WHEN bars < 250 THEN 'short' WHEN vol >= 0.30 AND cagr >= 0.10 THEN 'high-vol' WHEN mdd <= -0.40 OR cagr < 0.05 THEN 'cycle' WHEN vol < 0.18 AND crossings >= 9 THEN 'smooth' ELSE 'trend' END AS type FROM tf)"""

SIGNALS_SQL = """
sp(type, use_b1, fast_block, panel, hold, trail) AS (VALUES ('smooth', true, false, 8, false, 0.08), ('trend', true, false, 9, true, 0.15), ('high-vol', false, true, 8, true, 0.30), ('cycle', true, false, 9, true, 0.12), ('short', true, true, 9, true, 0.15)),
sg AS (SELECT mk.*, ty.type, use_b1, fast_block, hold, CAST(trail AS DOUBLE) AS trail, (ae_buy OR (use_b1 AND b1)) AND NOT (fast_block AND fast) AS buy, CASE WHEN panel = 9 THEN ae_sell ELSE fig8_sell END AS sell FROM mk JOIN ty ON ty.code = mk.code JOIN sp ON sp.type = ty.type)"""

QUOTE_SQL = """CASE WHEN fig9_lower IS NULL THEN 'no rail' WHEN fast_block AND fast THEN 'blocked as fast' WHEN buy THEN 'buy today' WHEN use_b1 AND disc_ok AND NOT near_lo THEN 'rail is enough'
  WHEN NOT aux_buy THEN 'aux incomplete' WHEN near_lo THEN 'in band already' ELSE 'price missing' END"""

MACHINE_SQL = """
nb AS (SELECT code, max(rn) AS n FROM sg GROUP BY code),
st AS (SELECT code, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DOUBLE) AS close, CAST(NULL AS BIGINT) AS fill, CAST(NULL AS DOUBLE) AS peak, false AS latch, CAST(1 AS DOUBLE) AS eq, CAST(0 AS BIGINT) AS trades, 'none' AS action, CAST(0 AS DOUBLE) AS held, CAST(0 AS DOUBLE) AS next_held, false AS by_trail, false AS masked FROM nb
  UNION ALL
  SELECT code, rn, close, CASE WHEN flat THEN CASE WHEN buy THEN rn + 1 END WHEN out THEN NULL ELSE fill END, pk, la, eq * (1 + was * coalesce(close / before - 1, 0) - abs(held - was) * 0.0005), trades + CASE WHEN out AND rn < n THEN 1 ELSE 0 END,
    CASE WHEN flat AND buy THEN 'buy' WHEN flat THEN 'none' WHEN out THEN 'sell' ELSE 'hold' END, held, CASE WHEN (flat AND buy) OR (NOT flat AND NOT out) THEN 1 ELSE 0 END, out AND NOT sells, mask
  FROM (SELECT *, NOT flat AND (sells OR (rn > fill AND close <= pk * (1 - trail))) AS out FROM
    (SELECT *, NOT flat AND rn >= fill AND sell AND NOT la AS sells, NOT flat AND rn >= fill AND sell AND la AS mask FROM
      (SELECT s.code, s.rn, s.close, s.buy, s.sell, s.trail, t.fill, t.fill IS NULL AS flat, t.eq, t.trades, t.held AS was, t.next_held AS held, t.close AS before, nb.n,
         CASE WHEN t.fill IS NULL THEN CASE WHEN s.buy THEN NULL ELSE t.peak END WHEN s.rn >= t.fill THEN greatest(coalesce(t.peak, s.close), s.close) ELSE t.peak END AS pk,
         CASE WHEN t.fill IS NULL THEN t.latch AND NOT s.buy ELSE t.latch OR (s.g1 AND s.hold) END AS la
       FROM st t JOIN sg s ON s.code = t.code AND s.rn = t.rn + 1 JOIN nb ON nb.code = s.code) a) b) c),
mc AS (SELECT st.code, st.trades + CAST(st.held AS BIGINT) AS trades, eq, action, st.held = 1 AS holding, latch AND action <> 'none' AS latch, CASE WHEN action <> 'none' THEN peak END AS peak, by_trail, masked FROM st JOIN nb ON nb.code = st.code AND nb.n = st.rn)"""

SNAPSHOT_SQL = """
la AS (SELECT sg.*, mc.action, mc.holding, mc.by_trail, mc.masked, near_lo AND NOT was_lo AS near_lo_edge, near_hi AND NOT was_hi AS near_hi_edge FROM sg JOIN nb ON nb.code = sg.code AND nb.n = sg.rn JOIN mc ON mc.code = sg.code)"""
_TRIGGERS = (
    ("near lower rail, rising", "near_lo_edge"), ("aux buy", "aux_buy"), ("aux_edge buy", "ae_buy"), ("B1", "b1"), ("fast", "fast"), ("buy signal", "buy"), ("near upper rail of 9", "near_hi"), ("aux sell", "aux_sell"),
    ("sell A", "near_hi_edge AND aux_sell"), ("stretch B", "stretch"), ("near upper rail of 8", "near_hi8"), ("sell signal", "sell"), ("G1 today", "g1"), ("trailing stop", "by_trail"), ("sell masked by G1", "masked"),
)
_LISTED = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in _TRIGGERS)
_SHARE = lambda x, n: f"CAST(len(list_filter(list({x}) OVER {_F(n)}, lambda v: v <= {x})) AS DOUBLE) / nullif(count({x}) OVER {_F(n)}, 0)"

_START, _MACHINE = f"WITH {BARS},{RAILS}", f"WITH RECURSIVE {BARS},{RAILS},{RULES_SQL},{TYPES_SQL},{SIGNALS_SQL},{MACHINE_SQL}"
ORACLE_SQL = {
    "w06_hist_percentile": f"WITH {BARS},{STEP1}, v AS (SELECT code, date, round(rv20, 9) AS rv FROM feat) SELECT code, date, round(CASE WHEN rv IS NOT NULL AND count(rv) OVER {_F(120)} >= 5 THEN {_SHARE('rv', 120)} END, 6) AS pct FROM v",
    "w22_low_vol_persistence": f"""WITH {BARS},{STEP1}, v AS (SELECT code, date, p20, p60, round(rv20, 9) AS rv FROM feat),
l AS (SELECT *, CASE WHEN rv IS NOT NULL AND count(rv) OVER {_F(252)} >= 60 AND {_SHARE('rv', 252)} < 0.35 THEN 1 ELSE 0 END AS low FROM v) SELECT code, date, sum(low) OVER {_F(15)} >= 10 AND NOT (abs(p60) >= 0.12 OR abs(p20) >= 0.08) AS ranged FROM l""",
    "x27_mask_variants": f"""{_START},{RULES_SQL} SELECT code, date, near_lo AS raw_buy, near_hi OR stretch AS raw_sell, near_lo AND NOT was_lo AS edge_buy, (near_hi AND NOT was_hi) OR stretch AS edge_sell, near_lo AND aux_buy AS aux_buy, (near_hi AND aux_sell) OR stretch AS aux_sell,
  ae_buy AS aux_edge_buy, ae_sell AS aux_edge_sell, near_lo AND aux_buy AND locmin AS aux_extrema_buy, (near_hi AND aux_sell AND locmax) OR stretch AS aux_extrema_sell FROM mk""",
    "x28_rule_masks": f"{_START},{RULES_SQL} SELECT code, date, ae_buy, ae_sell, b1, fast, fig8_sell, g1 FROM mk",
    "x29_touch_frame": f"{_START},{RULES_SQL} SELECT code, date, near_lo, near_hi, aux_buy, aux_sell, locmin, locmax, stretch, round(gap_5d, 4) + 0.0::DOUBLE AS gap_5d, round(gap_20d, 4) + 0.0::DOUBLE AS gap_20d, round(fig9_pos, 4) + 0.0::DOUBLE AS fig9_pos, round(vol5_pct, 4) + 0.0::DOUBLE AS vol5_pct FROM mk",
    "a20_type_features": f"{_START},{TYPES_SQL} SELECT code, bars, round(vol, 5) AS vol, round(total, 5) AS total, round(cagr, 5) AS cagr, round(mdd, 5) AS mdd, round(crossings, 5) AS crossings, type FROM ty",
    "x27_spec_signals": f"{_START},{RULES_SQL},{TYPES_SQL},{SIGNALS_SQL} SELECT code, date, type, buy, sell FROM sg",
    "x30_flat_quote": f"{_START},{RULES_SQL},{TYPES_SQL},{SIGNALS_SQL} SELECT code, date, round(fig9_lower * 1.01, 3) AS quote, {QUOTE_SQL} AS status FROM sg",
    "p12_rule_machine": f"{_MACHINE} SELECT mc.code, CAST(trades AS INTEGER) AS trades, round(eq, 6) AS equity, action, holding, latch, round(peak, 4) AS peak, round(peak * (1 - trail), 4) AS stop, by_trail AS trail_hit, masked AS sell_masked FROM mc JOIN (SELECT DISTINCT code, trail FROM sg) s ON s.code = mc.code",
    "x31_snapshot": f"""{_MACHINE},{SNAPSHOT_SQL} SELECT code, date, type, action, holding, round(close / fig9_lower - 1, 4) + 0.0::DOUBLE AS dist_lo9, round(close / fig9_upper - 1, 4) + 0.0::DOUBLE AS dist_hi9, round(close / fig8_upper - 1, 4) + 0.0::DOUBLE AS dist_hi8, {", ".join(f"round({c}, 4) + 0.0::DOUBLE AS {c}" for c in READINGS[3:])},
  near_lo_edge, near_hi_edge, near_hi_edge AND aux_sell AS sell_a, coalesce(fig7_gap >= 0.05, false) OR coalesce(fig10_pos >= 0.90, false) AS prem_or_pos10, round(fig9_lower * 1.01, 3) AS quote, {QUOTE_SQL} AS quote_status, array_to_string(list_filter([{_LISTED}], lambda x: x IS NOT NULL), '; ') AS triggers FROM la""",
    "m24_recommendations": f"""{_START},{RULES_SQL},{TYPES_SQL},{SIGNALS_SQL},
lb AS (SELECT code, max_by(close / fig9_lower - 1, date) AS d FROM sg WHERE buy GROUP BY code),
lr AS (SELECT code, max_by(r20, date) AS ret FROM bl GROUP BY code),
cl AS (SELECT code, substr(code, 1, 1) AS cluster, code LIKE '%L' AS rep, round(ret * 100, 4) AS ret20 FROM lr WHERE substr(code, 1, 1) <> 'E'),
ck AS (SELECT lr.code, CASE WHEN lb.d IS NULL THEN 'none' ELSE 'buy' END AS action, lb.d, cl.cluster, coalesce(cl.rep, false) AS rep, cl.ret20 FROM lr LEFT JOIN lb ON lb.code = lr.code LEFT JOIN cl ON cl.code = lr.code),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster, action ORDER BY rep DESC, abs(ret20) DESC NULLS LAST, d NULLS LAST, code) AS k FROM ck)
SELECT code, action, cluster, rep AS is_representative, round(ret20, 4) AS ret20_pct, action = 'buy' AND (cluster IS NULL OR k = 1) AS recommend FROM rk""",
}
ORACLE_SQL = {name: other_sql(text) for name, text in ORACLE_SQL.items()}
