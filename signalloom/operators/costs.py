"""Execution-cost models as column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000.0


@dataclass(frozen=True)
class Scenario:
    """Rates of one cost scenario."""

    per_share: float
    minimum: float
    half_spread_bps: float
    slippage_bps: float
    impact: float
    borrow_rate: float
    participation: float
    research: float


BASE = Scenario(0.005, 1.0, 2.0, 3.0, 0.1, 0.03, 0.01, 0.5)
CONSERVATIVE = Scenario(0.01, 1.0, 4.0, 6.0, 0.2, 0.06, 0.01, 0.5)


def commission(quantity: Column, s: Scenario) -> Column:
    return F.when(quantity == 0, 0.0).otherwise(F.greatest(F.lit(s.minimum), F.abs(quantity) * s.per_share))


def bps_of(quantity: Column, price: Column, bps: float) -> Column:
    """Half spread and slippage: a share of the notional."""
    return F.abs(quantity * price) * bps / BPS


def impact(quantity: Column, price: Column, volume: Column, s: Scenario) -> Column:
    """Notional times coefficient times squared participation (capped); null where volume isn't positive."""
    part = F.when(volume > 0, F.least(F.abs(quantity) / volume, F.lit(s.participation)))
    return F.abs(quantity * price) * s.impact * part * part


def borrow(short_notional: Column, s: Scenario, days: int | Column) -> Column:
    return F.abs(short_notional) * s.borrow_rate * days / 252.0


def locate_allowed(target: Column, located: Column) -> Column:
    """Longs always; shorts where the name can be borrowed."""
    return (target >= 0) | F.coalesce(located, F.lit(False))


def one_way(quantity: Column, price: Column, volume: Column, s: Scenario) -> dict[str, Column]:
    """Components of a one-way trade."""
    return {"commissions": commission(quantity, s), "half_spread": bps_of(quantity, price, s.half_spread_bps), "slippage": bps_of(quantity, price, s.slippage_bps), "volume_impact": impact(quantity, price, volume, s)}


def round_trip(quantity: Column, price: Column, volume: Column, direction: Column, holding: int, s: Scenario) -> Column:
    """Estimated total: both ways at the entry's price, borrow of shorts over the holding, research once."""
    both = sum((2 * c for c in one_way(quantity, price, volume, s).values()), F.lit(0.0))
    return both + borrow(F.when(direction < 0, quantity * price).otherwise(0.0), s, holding) + s.research
