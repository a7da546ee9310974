"""Indicators of a bar table as chained SQL views; each starts from the one before and keeps its columns.

A rolling value is null until its frame holds the least number of values that are not null (``min_periods``).
"""


def frame(n: int) -> str:
    return f"PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


SEEN = "PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ORDER = "PARTITION BY code ORDER BY date"


def roll(what: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER ({frame(n)}) >= {least} THEN {what}({x}) OVER ({frame(n)}) END"


#: Moving averages, ratio returns, ranges, true range, directional movement.
STEP1 = f"""
f1 AS (SELECT *, row_number() OVER ({ORDER}) AS rn, lag(close) OVER ({ORDER}) AS pc, lag(high) OVER ({ORDER}) AS ph, lag(low) OVER ({ORDER}) AS pl,
  {roll("avg", "close", 5, 3)} AS ma5, {roll("avg", "close", 10, 5)} AS ma10, {roll("avg", "close", 20, 10)} AS ma20, {roll("avg", "close", 60, 30)} AS ma60,
  close / nullif(lag(close, 20) OVER ({ORDER}), 0) - 1 AS prior20, close / nullif(lag(close, 60) OVER ({ORDER}), 0) - 1 AS prior60,
  {roll("max", "high", 60, 20)} AS roll_hi60, {roll("min", "low", 60, 20)} AS roll_lo60, {roll("max", "high", 20, 5)} AS hi20, {roll("min", "low", 20, 5)} AS lo20 FROM bars),
f2 AS (SELECT *, (roll_hi60 - roll_lo60) / nullif(close, 0) AS band60, close / nullif(pc, 0) - 1 AS ret1, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE CAST(0 AS DOUBLE) END AS pdm,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE CAST(0 AS DOUBLE) END AS mdm FROM f1),
f3 AS (SELECT *, {roll("avg", "tr", 20, 10)} / nullif(close, 0) AS atr20, {roll("stddev_samp", "ret1", 20, 10)} * sqrt(CAST(252 AS DOUBLE)) AS rv20,
  nullif({roll("avg", "tr", 14, 7)}, 0) AS atr14, {roll("avg", "pdm", 14, 7)} AS pdm14, {roll("avg", "mdm", 14, 7)} AS mdm14 FROM f2),
f4 AS (SELECT *, 100 * pdm14 / atr14 AS plus_di, 100 * mdm14 / atr14 AS minus_di FROM f3),
f5 AS (SELECT *, coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0) AS dx FROM f4),
feat AS (SELECT *, {roll("avg", "dx", 14, 7)} AS adx14, coalesce(prior20, 0) AS p20, coalesce(prior60, 0) AS p60 FROM f5)"""

#: Raw labels of the segmentation methods, one column each.
LABELS = """
lab AS (SELECT *,
  CASE WHEN ma20 IS NULL OR ma60 IS NULL THEN 'range'
    WHEN ((ma20 > ma60 AND close > ma20 AND (p60 >= 0.03 OR p20 >= 0.03)) OR (close > ma20 AND p20 >= 0.06 AND (ma20 > ma60 OR p60 <= -0.08 OR p60 >= 0.08)))
      AND NOT (ma20 < ma60 AND close < ma20 AND (p60 <= -0.03 OR p20 <= -0.03)) THEN 'up'
    WHEN ma20 < ma60 AND close < ma20 AND (p60 <= -0.03 OR p20 <= -0.03)
      AND NOT (close > ma20 AND p20 >= 0.06) THEN 'down' ELSE 'range' END AS g1_raw,
  CASE WHEN ma20 IS NULL OR ma60 IS NULL THEN 'range'
    WHEN ma20 > ma60 AND close > ma20 AND close >= ma60 AND (p60 >= 0.02 OR p20 >= 0.02) THEN 'up'
    WHEN ma20 < ma60 AND close < ma20 AND close <= ma60 AND (p60 <= -0.02 OR p20 <= -0.02) THEN 'down' ELSE 'range' END AS g2_raw,
  CASE WHEN ma20 IS NULL OR ma60 IS NULL THEN 'range'
    WHEN (ma20 > ma60 AND close > ma20 AND p60 >= 0.06 AND p20 >= 0)
      OR (close > ma20 AND p20 >= 0.06 AND (ma20 > ma60 OR (p60 <= -0.08 AND ma60 > 0 AND ma20 / nullif(ma60, 0) - 1 > -0.05 AND (pc IS NULL OR close >= pc)) OR p60 >= 0.08))
      OR (ma20 > ma60 AND close > ma20 AND p60 >= 0.18 AND p20 >= -0.08) THEN 'up'
    WHEN ma20 < ma60 AND close < ma20 AND p60 <= -0.06 AND p20 <= 0 THEN 'down' ELSE 'range' END AS g3_raw,
  CASE WHEN ma20 IS NULL OR ma60 IS NULL THEN 'range'
    WHEN abs(ma20 - ma60) / nullif(close, 0) < 0.025 AND NOT (close > ma20 AND (p20 >= 0.04 OR p60 >= 0.06)) AND NOT (close < ma20 AND (p20 <= -0.04 OR p60 <= -0.06)) THEN 'range'
    WHEN (ma20 > ma60 AND close > ma20 AND close >= ma60) OR (close > ma20 AND (p20 >= 0.04 OR p60 >= 0.06)) THEN 'up'
    WHEN (ma20 < ma60 AND close < ma20 AND close <= ma60) OR (close < ma20 AND (p20 <= -0.04 OR p60 <= -0.06)) THEN 'down' ELSE 'range' END AS g4_raw,
  CASE WHEN coalesce(adx14, 0) < 18 THEN
      CASE WHEN ma20 > ma60 AND close >= ma20 AND (p20 >= 0.02 OR p60 >= 0.03) THEN 'up'
           WHEN ma20 < ma60 AND close <= ma20 AND (p20 <= -0.02 OR p60 <= -0.03) THEN 'down' ELSE 'range' END
    WHEN coalesce(plus_di, 0) > coalesce(minus_di, 0) THEN 'up' WHEN coalesce(plus_di, 0) < coalesce(minus_di, 0) THEN 'down' ELSE 'range' END AS g5_raw,
  CASE WHEN band60 < 0.22 AND abs(p60) < 0.10 THEN 'range'
    WHEN p60 >= 0.10 AND coalesce(close > ma20, false) THEN 'up' WHEN p60 <= -0.10 AND NOT coalesce(close > ma20, false) THEN 'down'
    WHEN p60 >= 0.05 AND coalesce(close > ma20, false) THEN 'up' WHEN p60 <= -0.05 AND NOT coalesce(close > ma20, false) THEN 'down' ELSE 'range' END AS g6_raw FROM feat)"""


def smoothed(source: str, column: str, k: int, name: str) -> str:
    """Most frequent label of the last k bars; ties to the alphabetically first."""
    n = {x: f"sum(CASE WHEN {column} = '{x}' THEN 1 ELSE 0 END) OVER ({frame(k)})" for x in ("down", "range", "up")}
    return f"""
{name} AS (SELECT code, date, close, CASE WHEN n_down >= n_range AND n_down >= n_up THEN 'down' WHEN n_range >= n_up THEN 'range' ELSE 'up' END AS regime
  FROM (SELECT *, {n["down"]} AS n_down, {n["range"]} AS n_range, {n["up"]} AS n_up FROM {source}) t)"""


def islands(source: str, name: str) -> str:
    """Maximal runs of one label, numbered by ``seg``."""
    return f"""
{name}_e AS (SELECT *, CASE WHEN regime = lag(regime) OVER ({ORDER}) THEN 0 ELSE 1 END AS edge, lead(close) OVER ({ORDER}) AS next_close, lead(date) OVER ({ORDER}) AS next_date FROM {source}),
{name} AS (SELECT *, CAST(sum(edge) OVER ({SEEN}) AS BIGINT) AS seg FROM {name}_e)"""


#: Trades of holding while the label is up: bought at the first bar of a run, sold at the first bar after it.
TRADES = """
trades AS (SELECT code, seg, min(date) AS entry_date, min_by(close, date) AS entry, CASE WHEN count(next_date) = count(*) THEN max(next_date) END AS exit_date,
  CASE WHEN count(next_date) = count(*) THEN max_by(next_close, date) ELSE max_by(close, date) END AS exit_px, CASE WHEN count(next_date) = count(*) THEN 0 ELSE 1 END AS is_open
  FROM isl WHERE regime = 'up' GROUP BY code, seg)"""


def rails(panel: int, n: int) -> str:
    """Trailing log-linear fit over ``n`` bars: its value at the last bar, and yearly growth. While fewer bars than
    min(63, n) exist, the path is the close and the growth the series' own since its first bar."""
    least = min(63, n)
    w = frame(n)
    return f"""
r{panel}a AS (SELECT *, count(ly) OVER ({w}) AS n{panel}, regr_slope(ly, CAST(rn AS DOUBLE)) OVER ({w}) AS b{panel}, regr_avgy(ly, CAST(rn AS DOUBLE)) OVER ({w}) AS ay{panel}, regr_avgx(ly, CAST(rn AS DOUBLE)) OVER ({w}) AS ax{panel} FROM __FROM__),
r{panel} AS (SELECT *, CASE WHEN n{panel} >= {least} THEN exp(ay{panel} + b{panel} * (rn - ax{panel})) WHEN rn >= 2 THEN close END AS fig{panel}_path,
  CASE WHEN n{panel} >= {least} THEN exp(b{panel} * 252) - 1 WHEN rn >= 2 THEN power(close / p0, CAST(252 AS DOUBLE) / (rn - 1)) - 1 END AS fig{panel}_g FROM r{panel}a)"""


RAIL_BARS = {7: 504, 8: 252, 9: 126, 10: 63, 11: 21}


def rail_views() -> str:
    out, source = [], "fl"
    for panel, n in RAIL_BARS.items():
        out.append(rails(panel, n).replace("__FROM__", source))
        source = f"r{panel}"
    cols = [f"abs(ln(close / fig{p}_path)) AS res{p}" for p in RAIL_BARS]
    out.append(f"\nres AS (SELECT *, {', '.join(cols)} FROM {source})")
    env = [f"CASE WHEN count(res{p}) OVER ({SEEN}) >= 63 THEN @QUANTILE(res{p}, 0.95) OVER ({SEEN}) END AS dev{p}" for p in RAIL_BARS]
    out.append(f"\nenv AS (SELECT *, {', '.join(env)} FROM res)")
    bands = [f"fig{p}_path * exp(dev{p}) AS fig{p}_upper, fig{p}_path * exp(-dev{p}) AS fig{p}_lower, close / fig{p}_path - 1 AS fig{p}_gap" for p in RAIL_BARS]
    out.append(f"\nrails AS (SELECT *, {', '.join(bands)} FROM env)")
    return ",".join(out)


RAILS = f"""
fl AS (SELECT code, date, open, high, low, close, ln(close) AS ly, row_number() OVER ({ORDER}) AS rn, first_value(close) OVER ({SEEN}) AS p0 FROM bars)""" + "," + rail_views()
