"""Bars and a panel of correlated returns from the order tables, as SQL that starts a WITH clause.

Sums are of whole cents, so they are exact in any order.
"""

BARS = """
li AS (SELECT p.p_type AS code, CAST(l.l_shipdate AS DATE) AS date, CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents, CAST(l.l_quantity AS BIGINT) AS q
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
d AS (SELECT code, date, sum(cents) AS sc, sum(q) AS sq, max(cents) AS mx, min(cents) AS mn FROM li GROUP BY code, date),
k AS (SELECT code, sum(sc) AS tc, sum(sq) AS tq FROM d GROUP BY code),
r AS (SELECT d.code, d.date, 0.05 * (ln(CAST(sc AS DOUBLE) / sq) - ln(CAST(tc AS DOUBLE) / tq)) AS ret, 0.002 * ln(CAST(mx AS DOUBLE) / mn) AS spread, sq AS volume FROM d JOIN k ON d.code = k.code),
c AS (SELECT code, date, spread, volume, 100 * exp(sum(ret) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS close FROM r),
o AS (SELECT code, date, spread, volume, close, coalesce(lag(close) OVER (PARTITION BY code ORDER BY date), CAST(100.0 AS DOUBLE)) AS open FROM c),
bars AS (SELECT code, date, open, greatest(open, close) * exp(spread) AS high, least(open, close) * exp(-spread) AS low, close, CAST(volume AS DOUBLE) AS volume FROM o)"""

PANEL = """
li AS (SELECT p.p_brand AS code, CAST(substr(p.p_brand, 7) AS INT) % 4 AS grp, CAST(l.l_shipdate AS DATE) AS date, CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents, CAST(l.l_quantity AS BIGINT) AS q
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
b AS (SELECT code, grp, date, sum(cents) AS sc, sum(q) AS sq FROM li GROUP BY code, grp, date),
g AS (SELECT grp, date, sum(sc) AS sc, sum(sq) AS sq FROM b GROUP BY grp, date),
k AS (SELECT sum(sc) AS tc, sum(sq) AS tq FROM g),
panel AS (SELECT b.code, b.date, 0.05 * (ln(CAST(g.sc AS DOUBLE) / g.sq) - ln(CAST(k.tc AS DOUBLE) / k.tq)) + 0.01 * (ln(CAST(b.sc AS DOUBLE) / b.sq) - ln(CAST(k.tc AS DOUBLE) / k.tq)) AS ret, CAST(b.sq AS DOUBLE) AS volume
          FROM b JOIN g ON b.grp = g.grp AND b.date = g.date CROSS JOIN k)"""
