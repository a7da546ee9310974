"""Rules on the readings of a scored day, as expressions: jumps, tails, the transition score, the direction, and the
doubts about a model.

A day's readings: now (the last return), std20 (deviation of the last 20 returns), mean5 and mean5_before (means of the
last five returns, and of the five before the last), return_z, prev and raw (states before and after the return),
p_transition, emission_surprise, separated, p_into_reversal, pred_cdf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hmm import NAMES, SEPARATED

#: Fixed values of the rules.
JUMP, SURPRISE, TAIL, MU_MULTIPLE, MASS = 2.5, 2.0, 0.90, 0.25, 0.02
CALM, BEAR, REVERSAL = NAMES

_AGAINST = "(now > 0) <> ({m} > 0) OR abs({m}) < 1e-12"
#: What a jump means, the first line that holds: condition, weight, state.
JUMPS = (
    (f"prev = '{BEAR}' AND now > 0", 0.85, f"'{REVERSAL}'"),
    (f"prev = '{REVERSAL}' AND now < 0", 0.70, f"'{BEAR}'"),
    (_AGAINST.format(m="mean5_before"), 0.60, f"CASE WHEN now > 0 THEN '{REVERSAL}' END"),
    ("true", 0.35, "NULL"),
)
_SIZE = "coalesce(abs(now) / nullif(std20, 0), 0D)"


def jump_score() -> Column:
    """0 below ``JUMP`` deviations; above, the weight of what it means, in full from one and a half times that size."""
    cases = " ".join(f"WHEN {when} THEN {weight}D" for when, weight, _ in JUMPS)
    return F.expr(f"CASE WHEN {_SIZE} < {JUMP} THEN 0D ELSE least(1D, {_SIZE} / {JUMP * 1.5}) * CASE {cases} END END")


def jump_state() -> Column:
    cases = " ".join(f"WHEN {when} THEN {state}" for when, _, state in JUMPS)
    return F.expr(f"CASE WHEN {_SIZE} >= {JUMP} THEN CASE {cases} END END")


def rule_score() -> Column:
    """For states that aren't separated: a jump against, or out of, the mean of the last five returns."""
    return F.expr(f"CASE WHEN NOT separated AND {_SIZE} > {JUMP} AND ({_AGAINST.format(m='mean5')}) THEN 0.7D ELSE 0D END")


def jump_evidence() -> Column:
    """How far an upward jump is beyond ``JUMP`` deviations of the 20 returns before it, within 0 and 1."""
    return F.expr(f"CASE WHEN now > 0 AND return_z >= {JUMP} THEN least(1D, (return_z - {JUMP}) / {JUMP}) ELSE 0D END")


def switch_side() -> Column:
    return F.expr(f"CASE WHEN pred_cdf >= {TAIL} THEN 'up' WHEN pred_cdf <= {1 - TAIL:.2f} THEN 'down' END")


def tail_score() -> Column:
    """From a half at the edge of a tail to 1 at its end."""
    depth = "greatest(pred_cdf, 1 - pred_cdf)"
    return F.expr(f"CASE WHEN {depth} >= {TAIL} THEN 0.5 + 0.5 * least(1D, ({depth} - {TAIL}) / {1 - TAIL:.2f}) ELSE 0D END")


def with_rules(rows: DataFrame) -> DataFrame:
    """``rows`` of readings with regime_now, prev_regime, transition_score, direction, direction_up, quantile_switch,
    switch_side and p_into_reversal_adj."""
    rows = rows.withColumns({"_jump": jump_score(), "_state": jump_state(), "switch_side": switch_side(), "_tail": tail_score()})
    rows = rows.withColumn("regime_now", F.expr(f"coalesce(CASE switch_side WHEN 'up' THEN '{REVERSAL}' WHEN 'down' THEN '{BEAR}' END, _state, raw)"))
    model = F.expr(f"p_transition * least(emission_surprise / {SURPRISE}, 3D) * CASE WHEN separated THEN 1D ELSE 0.5D END")
    by_jump = f"CASE WHEN _jump > 0 THEN CASE _state WHEN '{REVERSAL}' THEN 'up' WHEN '{BEAR}' THEN 'down' END END"
    by_change = f"CASE WHEN prev <> regime_now AND regime_now = '{REVERSAL}' AND now > 0 THEN 'up' WHEN prev <> regime_now AND regime_now = '{BEAR}' AND now < 0 THEN 'down' END"
    rows = rows.withColumns({
        "transition_score": F.least(F.greatest(model, rule_score(), "_jump", "_tail"), F.lit(1.0)),
        "direction": F.expr(f"coalesce(switch_side, {by_jump}, {by_change}, 'mixed')"),
        "prev_regime": F.expr("nullif(prev, regime_now)"),
        "quantile_switch": F.col("switch_side").isNotNull(),
        "p_into_reversal_adj": F.greatest("p_into_reversal", jump_evidence(), F.expr("CASE WHEN switch_side = 'up' THEN _tail ELSE 0D END")),
    })
    return rows.withColumn("direction_up", F.col("direction") == "up").drop("_jump", "_state", "_tail")


# ---- doubts about a model


def with_doubts(models: DataFrame, drift: bool = False) -> DataFrame:
    """``models`` (reliable, failure, separation, mu, sigma, mass, typical: the median absolute return) with reasons, all
    doubts joined by bars, and ambiguous: whether the named states can't be told apart for good. With ``drift``, a model is
    held against the one before it of its code, by month: the two wilder states may have changed places."""
    apart = lambda a, b: f"abs(mu[{a}] - _mu[{b}]) + abs(sigma[{a}] - _sigma[{b}])"
    lines = {
        "sigma_not_separated": f"separation < {SEPARATED}",
        "direction_mu_not_separated": f"size(mu) = 3 AND abs(mu[1] - mu[2]) < {MU_MULTIPLE} * greatest(coalesce(typical, 0D), 1e-12)",
        "low_effective_state_mass": f"array_min(_share) < {MASS}",
        "single_state_collapse": f"size(filter(_share, x -> x >= {MASS})) < 2",
        "semantic_label_drift": " OR ".join(f"{apart(a, b)} + 1e-12 < {apart(a, a)}" for a, b in ((1, 2), (2, 1))),
    }
    last = Window.partitionBy("code").orderBy("month")
    kept = models.columns
    none = F.lit(None).cast("array<double>")
    rows = models.withColumns({c: F.lag(F.when(F.col("reliable"), F.col(c[1:]))).over(last) if drift else none for c in ("_mu", "_sigma")})
    rows = rows.withColumn("_share", F.expr("transform(mass, x -> x / greatest(aggregate(mass, 0D, (a, b) -> a + b), 1e-12))"))
    found = F.array_compact(F.array(*[F.when(F.expr(when), F.lit(name)) for name, when in lines.items()]))
    rows = rows.withColumn("_doubts", F.when(F.col("reliable"), found).otherwise(F.array(F.coalesce("failure", F.lit("fit_unreliable")))))
    hard = F.arrays_overlap("_doubts", F.array(F.lit("semantic_label_drift"), F.lit("single_state_collapse"))) | (F.size(F.array_intersect("_doubts", F.array(F.lit("sigma_not_separated"), F.lit("direction_mu_not_separated")))) == 2)
    return rows.withColumns({"reasons": F.array_join("_doubts", "|"), "ambiguous": ~F.col("reliable") | hard}).select(*kept, "reasons", "ambiguous")
