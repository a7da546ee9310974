"""The filter's weights at a bar and what follows from them, as expressions over arrays: no Python worker takes part.

A row has the returns up to its bar and a frozen model of three states: trans (nine numbers by row), mu, sigma. Densities
are scaled by their sum over the states at each return, which the weights don't depend on, so that many steps in a row
don't run out of range; the weights are brought to one at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees of freedom of the emissions.
NU = 5.0
STATES = range(3)
HORIZONS = (5, 10, 20)


def emissions(returns: Column, mu: Column, sigma: Column) -> Column:
    """For each return the densities of the states, scaled to a sum of one."""
    density = lambda r, i: F.pow(1 + F.pow((r - mu[i]) / sigma[i], 2) / NU, F.lit(-(NU + 1) / 2)) / sigma[i]
    raw = F.transform(returns, lambda r: F.array(*[density(r, i) for i in STATES]))
    return F.transform(raw, lambda d: F.transform(d, lambda x: x / (d[0] + d[1] + d[2])))


def step(weights: Column, trans: Column) -> list[Column]:
    """Weights of the states one bar on."""
    return [sum((weights[i] * trans[3 * i + j] for i in STATES), F.lit(0.0)) for j in STATES]


def with_summaries(rows: DataFrame, returns: str = "returns") -> DataFrame:
    """``rows`` with p_switch and p_into_reversal of the last return, state (weights after it), next (weights at the next
    bar) and stay5, stay10, stay20 (the chance that the last state isn't left so long). The filter starts from equal weights
    before the first return; with fewer than two returns all are null."""
    rows = rows.withColumn("_t", F.transform("trans", lambda x: F.greatest(x, F.lit(1e-12)))).withColumn("_e", emissions(F.col(returns), F.col("mu"), F.col("sigma")))
    n = F.size(returns)
    before = F.aggregate(F.slice("_e", 1, F.greatest(n - 1, F.lit(0))), F.array(*[F.lit(1 / 3)] * 3), lambda a, e: F.array(*[w * e[j] for j, w in enumerate(step(a, F.col("_t")))]))
    rows = rows.withColumn("_a", before)
    joint = F.array(*[F.col("_a")[i] * F.col("_t")[3 * i + j] * F.element_at("_e", -1)[j] for i in STATES for j in STATES])
    rows = rows.withColumn("_j", F.when(n >= 2, joint)).withColumn("_s", F.aggregate("_j", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("_j", F.transform("_j", lambda x: x / F.col("_s")))
    j = F.col("_j")
    rows = rows.withColumn("state", F.array(*[sum((j[3 * i + k] for i in STATES), F.lit(0.0)) for k in STATES]))
    rows = rows.withColumns({"p_switch": 1 - j[0] - j[4] - j[8], "p_into_reversal": j[2] + j[5], "next": F.array(*step(F.col("state"), F.col("trans"))), **{f"stay{h}": F.when(n >= 2, F.pow(F.col("trans")[8], F.lit(float(h)))) for h in HORIZONS}})
    return rows.drop("_t", "_e", "_a", "_j", "_s")
