"""Rules on trend rails: masks, their composition by the type of a series, and their evaluation to the last bar."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .rails import with_share

#: Fixed values of the rules.
NEAR, POSITION, POSITION10, PREMIUM, BUSY, EXTREMA = 0.01, 0.80, 0.90, 0.05, 0.70, 10
FAST_BARS, FAST_WINDOW, FAST_RISE, DISCOUNT, RISE10 = 40, 60, 0.20, -0.08, 0.30
PREMIUM_YEAR, YEAR, BARS_YEAR, COST = 0.043, 252, 250, 0.0005
#: (b1, fast_block, sell panel, g1_hold, trail) of each type of series.
SPECS = {"smooth": (True, False, 8, False, 0.08), "trend": (True, False, 9, True, 0.15), "high-vol": (False, True, 8, True, 0.30), "cycle": (True, False, 9, True, 0.12), "short": (True, True, 9, True, 0.15)}
VARIANTS = ("raw", "edge", "aux", "aux_edge", "aux_extrema")


def W():
    """Bars of a series in order."""
    return Window.partitionBy("code").orderBy("date")


def frame(n: int):
    return W().rowsBetween(1 - n, 0)


def full(what: Column, x: str, n: int) -> Column:
    """``what`` over the last n bars if none of their values is missing."""
    return F.when(F.count(x).over(frame(n)) == n, what.over(frame(n)))


def yes(x: Column) -> Column:
    """A mask: false where unknown."""
    return F.coalesce(x, F.lit(False))


def rising(x: Column) -> Column:
    return x & ~F.coalesce(F.lag(x).over(W()), F.lit(False))


def realised(bars: DataFrame) -> DataFrame:
    """``bars`` (code, date, close) with yearly volatility of the last 5 and 20 log returns."""
    steps = bars.withColumn("step", F.log(F.col("close") / F.lag("close").over(W())))
    vol = lambda n: full(F.stddev_pop("step"), "step", n) * F.sqrt(F.lit(float(YEAR)))
    return steps.withColumn("rv5", vol(5)).withColumn("rv20", vol(20)).drop("step")


def need(rv: Column, anchor: Column, bars: int) -> Column:
    """Return over so many bars that pays for the risk beside the anchor's; null for a loss of all or more."""
    year = PREMIUM_YEAR * rv / F.nullif(anchor, F.lit(0.0))
    return F.when(year > -1, F.pow(1 + year, F.lit(bars / YEAR)) - 1)


def gaps(bars: DataFrame, anchor: DataFrame) -> DataFrame:
    """(code, date, gap_5d, gap_20d, rv5): returns less what they need. Dates the anchor lacks have no gap."""
    known = realised(anchor.withColumn("code", F.lit("anchor"))).select("date", F.col("rv5").alias("a5"), F.col("rv20").alias("a20"))
    rows = realised(bars.select("code", "date", "close")).join(known, "date", "left")
    back = lambda n: F.col("close") / F.lag("close", n).over(W()) - 1
    return rows.select("code", "date", "rv5", (back(5) - need(F.col("rv5"), F.col("a5"), 5)).alias("gap_5d"), (back(20) - need(F.col("rv20"), F.col("a20"), 20)).alias("gap_20d"))


def rule_frame(rails: DataFrame, anchor: DataFrame) -> DataFrame:
    """The rails with moving averages, gaps, positions in the bands, local extrema, near and aux masks, and stretch."""
    close = F.col("close")
    more = with_share(gaps(rails, anchor), "rv5", 120, "vol5_share")
    # five volatilities at least, for a share to mean anything
    more = more.withColumn("vol5_pct", F.when(F.count("rv5").over(frame(120)) >= 5, F.col("vol5_share"))).drop("rv5", "vol5_share")
    rows = rails.join(more, ["code", "date"])
    position = lambda p: F.log(close / F.col(f"fig{p}_lower")) / F.nullif(F.log(F.col(f"fig{p}_upper") / F.col(f"fig{p}_lower")), F.lit(0.0))
    rows = rows.select(
        "*", full(F.avg("close"), "close", 5).alias("ma5"), full(F.avg("close"), "close", 20).alias("ma20"), position(9).alias("fig9_pos"), position(10).alias("fig10_pos"),
        *[yes(F.round(close - F.col(f"fig{p}_upper"), 7) >= 0).alias(f"touch_hi{p}") for p in (9, 10)],
        ((F.row_number().over(W()) > EXTREMA) & (close == F.min("close").over(frame(EXTREMA + 1)))).alias("locmin"), ((F.row_number().over(W()) > EXTREMA) & (close == F.max("close").over(frame(EXTREMA + 1)))).alias("locmax"),
    )
    rows = rows.select(
        "*", yes(close <= F.col("fig9_lower") * (1 + NEAR)).alias("near_lo"), yes(close >= F.col("fig9_upper") * (1 - NEAR)).alias("near_hi"), yes(close >= F.col("fig8_upper") * (1 - NEAR)).alias("near_hi8"),
        yes((close < F.col("ma20")) & (F.col("ma5") < F.col("ma20")) & (F.col("gap_5d") <= 0) & (F.col("gap_20d") <= 0) & ~F.col("touch_hi10")).alias("aux_buy"),
        yes((close > F.col("ma20")) & (F.col("ma5") > F.col("ma20")) & (F.col("gap_5d") >= 0) & (F.col("gap_20d") >= 0)).alias("aux_sell"),
    )
    stretch = F.col("aux_sell") & F.col("locmax") & (F.col("vol5_pct") >= BUSY) & (F.col("fig9_g") > 0) & ~(F.col("touch_hi9") | F.col("touch_hi10")) & (F.col("fig9_pos") >= POSITION) & ((F.col("fig7_gap") >= PREMIUM) | (F.col("fig10_pos") >= POSITION10))
    return rows.withColumn("stretch", yes(stretch))


def variant(name: str) -> tuple[Column, Column]:
    """(buy, sell) of a variant of the masks at panel 9's rails."""
    lo, hi, extra, buy, sell = (F.col(c) for c in ("near_lo", "near_hi", "stretch", "aux_buy", "aux_sell"))
    return {
        "raw": (lo, hi | extra), "edge": (rising(lo), rising(hi) | extra), "aux": (lo & buy, hi & sell | extra), "aux_edge": (rising(lo) & buy, rising(hi) & sell | extra),
        "aux_extrema": (lo & buy & F.col("locmin"), hi & sell & F.col("locmax") | extra),
    }[name]


def masks(rows: DataFrame) -> DataFrame:
    """A rule frame with ae_buy, ae_sell, b1, run40, fast, fig8_sell, pos9_10 and g1."""
    buy, sell = variant("aux_edge")
    rows = rows.select("*", buy.alias("ae_buy"), sell.alias("ae_sell"), (F.col("close") / F.lag("close", FAST_BARS).over(W()) - 1).alias("run"), (F.col("fig9_pos") - F.lag("fig9_pos", 10).over(W())).alias("pos9_10"))
    rows = rows.withColumn("run40", F.max("run").over(frame(FAST_WINDOW)))
    disc = yes((F.col("fig7_gap") <= DISCOUNT) | (F.col("fig8_gap") <= DISCOUNT))
    g1 = (F.col("fig7_g") > 0) & (F.col("fig8_g") > 0) & (F.col("pos9_10") >= RISE10) & (F.col("fig9_pos") >= POSITION) & ~F.col("touch_hi9") & (F.col("fig10_g") > F.col("fig9_g"))
    return rows.select("*", disc.alias("disc_ok"), (disc & F.col("near_lo")).alias("b1"), yes(F.col("run40") >= FAST_RISE).alias("fast"), (F.col("near_hi8") & F.col("aux_sell") | F.col("stretch")).alias("fig8_sell"), yes(g1).alias("g1")).drop("run")


def types(rails: DataFrame) -> DataFrame:
    """(code, bars, vol, total, cagr, mdd, crossings, type) of each series."""
    close, path = F.col("close"), F.col("fig7_path")
    above = F.when(path.isNotNull(), close >= path)
    rows = rails.select("code", "date", "close", (close / F.lag("close").over(W()) - 1).alias("r"), (close / F.max("close").over(W().rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("dd"), above.alias("above"))
    rows = rows.withColumn("crossed", yes(F.col("above") != F.coalesce(F.lag("above").over(W()), F.lit(False))) & F.lag("date").over(W()).isNotNull())
    years = F.count("*") / F.lit(float(BARS_YEAR))
    total = F.max_by("close", "date") / F.min_by("close", "date")
    out = rows.groupBy("code").agg(F.count("*").alias("bars"), (F.stddev_samp("r") * F.sqrt(F.lit(float(BARS_YEAR)))).alias("vol"), (total - 1).alias("total"), (F.pow(total, 1 / years) - 1).alias("cagr"), F.min("dd").alias("mdd"), (F.count_if("crossed") / years).alias("crossings"))
    kind = F.when(F.col("bars") < BARS_YEAR, "short").when((F.col("vol") >= 0.30) & (F.col("cagr") >= 0.10), "high-vol").when((F.col("mdd") <= -0.40) | (F.col("cagr") < 0.05), "cycle").when((F.col("vol") < 0.18) & (F.col("crossings") >= 9), "smooth").otherwise("trend")
    return out.withColumn("type", kind)


def specs(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in SPECS.items()], "type string, use_b1 boolean, fast_block boolean, sell_panel int, g1_hold boolean, trail double")


def signals(masked: DataFrame, typed: DataFrame, spec: DataFrame) -> DataFrame:
    """Masks with their series' type and spec, and the buy and sell signals that the spec makes of them. The spec has a
    row for each type and is small whatever the bars; the types have a row a series."""
    rows = masked.join(typed.select("code", "type").join(F.broadcast(spec), "type"), "code")
    buy = (F.col("ae_buy") | F.col("use_b1") & F.col("b1")) & ~(F.col("fast_block") & F.col("fast"))
    return rows.withColumn("buy", buy).withColumn("sell", F.when(F.col("sell_panel") == 9, F.col("ae_sell")).otherwise(F.col("fig8_sell")))


MACHINE = "code string, trades int, equity double, action string, holding boolean, latch boolean, peak double, stop double, trail_hit boolean, sell_masked boolean"


def machines(signalled: DataFrame) -> DataFrame:
    """The rule machine of each series to its last bar."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date", kind="stable")
        trail = float(g.trail.iloc[0])
        done = scans.rule_machine(g.close.to_numpy(), g.buy.to_numpy(), g.sell.to_numpy(), g1=g.g1.to_numpy() if g.g1_hold.iloc[0] else None, trail=trail, cost=COST)
        if done["action"] == "none":
            done |= {"peak": None, "latch": False}
        stop = done["peak"] * (1 - trail) if done["peak"] is not None and trail else np.nan
        return pd.DataFrame({
            "code": [g.code.iloc[0]], "trades": len(done["trades"]) + done["holding"], "equity": float(done["equity"][-1]), "action": done["action"], "holding": done["holding"], "latch": bool(done["latch"]),
            "peak": np.nan if done["peak"] is None else done["peak"], "stop": stop, "trail_hit": done["why"] == "trail", "sell_masked": bool(done["masked"]),
        })

    out = signalled.select("code", "date", "close", "buy", "sell", "g1", "g1_hold", "trail").groupBy("code").applyInPandas(run, MACHINE)
    return out.withColumn("peak", F.nanvl("peak", F.lit(None))).withColumn("stop", F.nanvl("stop", F.lit(None)))


#: What a last bar's readings trigger, in the order of the report: (name, flag).
TRIGGERS = (
    ("near lower rail, rising", "near_lo_edge"), ("aux buy", "aux_buy"), ("aux_edge buy", "ae_buy"), ("B1", "b1"), ("fast", "fast"), ("buy signal", "buy"), ("near upper rail of 9", "near_hi"), ("aux sell", "aux_sell"), ("sell A", "sell_a"),
    ("stretch B", "stretch"), ("near upper rail of 8", "near_hi8"), ("sell signal", "sell"), ("G1 today", "g1"), ("trailing stop", "trail_hit"), ("sell masked by G1", "sell_masked"),
)


def flat_quote(applicable: Column | None = None) -> tuple[Column, Column]:
    """(price that counts as touching panel 9's lower rail, why it is or isn't a buy)."""
    price = F.col("fig9_lower") * (1 + NEAR)
    status = F.when(price.isNull(), "no rail").when(~applicable if applicable is not None else F.lit(False), "rule not applicable").when(F.col("fast_block") & F.col("fast"), "blocked as fast").when(F.col("buy"), "buy today")
    status = status.when(F.col("use_b1") & F.col("disc_ok") & ~F.col("near_lo"), "rail is enough").when(~F.col("aux_buy"), "aux incomplete").when(F.col("near_lo"), "in band already").otherwise("price missing")
    return price, status


def snapshot(signalled: DataFrame, machine: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Readings of each series' last bar, with what the machine says of it. A series whose last bar isn't ``as_of`` has
    no row."""
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))
    edged = signalled.withColumn("near_lo_prev", F.coalesce(F.lag("near_lo").over(W()), F.lit(False))).withColumn("near_hi_prev", F.coalesce(F.lag("near_hi").over(W()), F.lit(False))).withColumn("last", last).where("last = 1")
    if as_of is not None:
        edged = edged.where(F.col("date") == as_of)
    close = F.col("close")
    rows = edged.join(machine, "code").withColumn("near_lo_edge", F.col("near_lo") & ~F.col("near_lo_prev")).withColumn("near_hi_edge", F.col("near_hi") & ~F.col("near_hi_prev")).withColumn("sell_a", F.col("near_hi_edge") & F.col("aux_sell"))
    flags = {
        "below_ma20": close < F.col("ma20"), "ma5_below": F.col("ma5") < F.col("ma20"), "gap5_le0": F.col("gap_5d") <= 0, "gap20_le0": F.col("gap_20d") <= 0, "fig10_not_hi": ~F.col("touch_hi10"), "above_ma20": close > F.col("ma20"),
        "ma5_above": F.col("ma5") > F.col("ma20"), "gap5_ge0": F.col("gap_5d") >= 0, "gap20_ge0": F.col("gap_20d") >= 0, "pos9_ok": F.col("fig9_pos") >= POSITION, "g9_pos": F.col("fig9_g") > 0, "no_touch_hi": ~(F.col("touch_hi9") | F.col("touch_hi10")),
        "vol5_ok": F.col("vol5_pct") >= BUSY, "prem7_ok": F.col("fig7_gap") >= PREMIUM, "pos10_ok": F.col("fig10_pos") >= POSITION10, "g7_pos": F.col("fig7_g") > 0, "g8_pos": F.col("fig8_g") > 0, "pos9_10_ok": F.col("pos9_10") >= RISE10,
        "not_touch9hi": ~F.col("touch_hi9"), "g10_gt_g9": F.col("fig10_g") > F.col("fig9_g"),
    }
    rows = rows.select("*", *[yes(c).alias(k) for k, c in flags.items()], *[(close / F.col(f"fig{p}_{rail}") - 1).alias(f"dist_{name}") for p, rail, name in ((9, "lower", "lo9"), (9, "upper", "hi9"), (8, "upper", "hi8"))], (close / F.col("stop") - 1).alias("dist_stop"))
    price, status = flat_quote()
    rows = rows.withColumn("prem_or_pos10", F.col("prem7_ok") | F.col("pos10_ok")).withColumn("quote", price).withColumn("quote_status", status)
    return rows.withColumn("triggers", F.array_join(F.array_compact(F.array(*[F.when(F.col(flag), name) for name, flag in TRIGGERS])), "; ")).drop("last")


def evaluate(rails: DataFrame, anchor: DataFrame, as_of: Column | None = None) -> DataFrame:
    """From rails to the last bar's readings: types, masks, signals, machine and snapshot."""
    signalled = signals(masks(rule_frame(rails, anchor)), types(rails), specs(rails.sparkSession))
    return snapshot(signalled, machines(signalled), as_of)


def recommended(checked: DataFrame, clusters: DataFrame) -> DataFrame:
    """``checked`` (code, action, dist_lo9, ...) with cluster, is_representative, ret20_pct and recommend: of today's buys of
    a cluster the representative, then the largest move, then the nearest to the rail, then the first code; a buy
    without cluster always."""
    first = Window.partitionBy("code").orderBy(F.desc("is_representative"), F.desc_nulls_last(F.abs("ret20_pct")), "cluster")
    known = clusters.withColumn("code", F.upper("code")).withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("code").alias("key"), "cluster", "is_representative", "ret20_pct")
    rows = checked.join(known, F.upper(checked["code"]) == F.col("key"), "left").drop("key").withColumn("is_representative", yes(F.col("is_representative")))
    best = Window.partitionBy("cluster", F.col("action") == "buy").orderBy(F.desc("is_representative"), F.desc_nulls_last(F.abs("ret20_pct")), F.asc_nulls_last("dist_lo9"), "code")
    return rows.withColumn("recommend", (F.col("action") == "buy") & (F.col("cluster").isNull() | (F.row_number().over(best) == 1)))
