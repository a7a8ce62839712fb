"""Predeclared decisions over one-row metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gates(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One column a gate (null counts as failed), ``passed``, and the names of failed gates."""
    out = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    ok = F.lit(True)
    for k in tests:
        ok = ok & F.col(k)
    failed = F.filter(F.array(*(F.when(~F.col(k), k) for k in tests)), lambda x: x.isNotNull())
    return out.withColumn("passed", ok).withColumn("failed", failed)


def evidence_decision(useful: Column, abstention: Column, other_share: Column) -> Column:
    """STOP without evidence; REVISE where abstention or 'other' exceeds half; else PROCEED."""
    return F.when(~F.coalesce(useful, F.lit(False)), "STOP").when((abstention > 0.5) | (other_share > 0.5), "REVISE").otherwise("PROCEED")


Pair = tuple[Column, Column]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def useful_evidence(horizons: Sequence[Pair]) -> Column:
    """Any horizon with a positive weighted rank correlation and a positive lower end of its company interval."""
    out = F.lit(False)
    for ic, lower in horizons:
        out = out | ((_zero(ic) > 0) & (_zero(lower) > 0))
    return out


def research_gates(*, ic: Pair, signed: Pair, baselines: Sequence[Pair], conservative_return: Pair, coverage: Column, intervals: Sequence[Pair], nearby: Column, concentration: Sequence[Column]) -> dict[str, Column]:
    """Seven gates over both horizons (5 and 21 sessions): association, more than the baselines, costs, coverage, intervals, neighbours, concentration."""
    best = [F.greatest(F.lit(0.0) if len(baselines) == 1 else _zero(baselines[0][h]), *(_zero(b[h]) for b in baselines)) for h in (0, 1)]
    return {
        "positive_association": _all([_zero(c) > 0 for c in (*ic, *signed)]),
        "more_than_baselines": _all([_zero(ic[h]) > best[h] for h in (0, 1)]),
        "survives_costs": _all([_zero(c) > 0 for c in conservative_return]),
        "coverage": F.coalesce(coverage >= 0.25, F.lit(False)),
        "intervals_positive": _all([_zero(c) > 0 for pair in intervals for c in pair]),
        "neighbours_stable": F.coalesce(nearby >= 0.60, F.lit(False)),
        "not_concentrated": _all([F.when(_zero(c) == 0, 1.0).otherwise(c) <= 0.25 for c in concentration]),
    }


def research_decision(gate_names: Sequence[str], *, ic: Pair, signed: Pair, conservative_sharpe: Pair) -> Column:
    """PASS at one of two scales where all gates (columns) hold, FAIL where both horizons are negative and costs aren't survived, else INCONCLUSIVE."""
    passed = _all([F.col(g) for g in gate_names])
    strong = _all([_zero(c) >= 0.75 for c in conservative_sharpe])
    negative = _all([_zero(c) <= 0 for c in (*ic, *signed)])
    return F.when(passed & strong, "PASS: Expand to 25,000").when(passed, "PASS: Expand to 10,000").when(negative & ~F.col("survives_costs"), "FAIL: Stop at 5,000").otherwise("INCONCLUSIVE: Stop at 5,000")


def promotion_gates(*, trades: Column, sharpe: Column, lower: Column, conservative_sharpe: Column, validation_return: Column, concentration: Column, least_trades: int = 30, least_sharpe: float = 0.75, most_share: float = 0.20) -> dict[str, Column]:
    """Six gates of a holdout book; promoted where all hold, a null fails."""
    return {"minimum_trades": trades >= least_trades, "minimum_sharpe": sharpe >= least_sharpe, "interval_positive": lower > 0, "conservative_sharpe": conservative_sharpe >= 0, "validation_return": validation_return > 0, "concentration": concentration <= most_share}


def selection_components(*, spearman: Column, floor: float, target: float, agreement: Sequence[Column], final_valid: Column, first_valid: Column, coverage: Column, other_coverage: Column, speed: Column, speed_target: float, cost: Column, cost_target: float) -> dict[str, Column]:
    """Six components from 0 to 1 by which a model is chosen."""
    one = F.lit(1.0)
    return {
        "predictive_performance": bounded(spearman, floor, target),
        "agreement": sum(agreement[1:], agreement[0]) / len(agreement),
        "valid_output": 0.75 * final_valid + 0.25 * first_valid,
        "tradable_coverage": F.greatest(F.lit(0.0), 1 - F.abs(coverage - other_coverage) / 0.75),
        "runtime": F.least(one, speed / speed_target),
        "electricity_cost": F.least(one, cost_target / F.greatest(cost, F.lit(1e-12))),
    }


def select_best(df: DataFrame, components: dict[str, Column], weights: dict[str, float], key: str) -> DataFrame:
    """Components, their weighted ``total`` and ``chosen``: the row of most, of equal ones the least key. Weights must sum to 1."""
    if set(weights) != set(components) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must cover the components and sum to 1")
    rows = df.withColumns(components)
    rows = rows.withColumn("total", sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))
    best = rows.agg(F.max_by(key, F.struct(F.round("total", 10), -F.col(key))).alias("_best"))
    return rows.join(F.broadcast(best)).withColumn("chosen", F.col(key) == F.col("_best")).drop("_best")


def bounded(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))
