"""Margins, budgets, distances and peer weights as plain column arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Required net margin by purchase price in EUR.
MARGIN_TIERS = ((5_000, 2_000), (10_000, 3_000), (15_000, 4_000), (20_000, 5_000))
RESERVE_EUR = 750
EARTH_RADIUS_KM = 6371.0088


def required_margin(price: Column | str) -> Column:
    """Required net margin in EUR; NULL for a missing or non-positive price."""
    p = col(price)
    (a, ma), (b, mb), (c, mc), (top, base) = MARGIN_TIERS
    over = F.greatest(F.lit(0), F.ceil((p - top) / 5000)).cast("bigint")
    return (
        F.when(p <= 0, F.lit(None).cast("bigint"))
        .when(p < a, F.lit(ma))
        .when(p < b, F.lit(mb))
        .when(p < c, F.lit(mc))
        .when(p.isNotNull(), base + 1000 * over)
        .cast("bigint")
    )


def price_band(price: Column | str) -> Column:
    return F.least(F.lit(3), F.floor(col(price) / 5000)).cast("int")


def whole_div(value: Column, by: int) -> Column:
    """Floor division on integers, for either sign."""
    return F.floor(value / F.lit(by)).cast("bigint")


def peer_weight_nano(year_gap: Column, km_gap: Column, age_days: Column) -> Column:
    """Closeness weight in (0, 1], kept as whole billionths so that sums are exact."""
    weight = F.lit(1.0) / (F.lit(1.0) + year_gap + km_gap / F.lit(20000.0) + age_days / F.lit(30.0))
    return F.floor(weight * F.lit(1e9) + F.lit(0.5)).cast("bigint")


def peer_weights_nano(year_gap: np.ndarray, km_gap: np.ndarray, age_days: np.ndarray) -> np.ndarray:
    """``peer_weight_nano`` of arrays, by the same steps in double precision."""
    return np.floor(1.0 / (1.0 + year_gap + km_gap / 20000.0 + age_days / 30.0) * 1e9 + 0.5).astype("int64")


def age_days(as_of: Column, observed_at: Column | str) -> Column:
    """Elapsed days, exact to the microsecond."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(observed_at).cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)


def distance_km(lat1: Column, lon1: Column, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance with the haversine term clamped to [0, 1]."""
    lat2, lon2 = col(lat2), col(lon2)
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return EARTH_RADIUS_KM * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def stressed_exit(reference: Column, percent: int = 85) -> Column:
    return whole_div(reference * percent, 100)


def feasibility(price: Column, reference: Column, confidence: Column) -> dict[str, Column]:
    """Necessary cost budget after a 15 % resale stress, the fixed reserve and the margin."""
    exit_ceiling = stressed_exit(reference)
    required = required_margin(price)
    budget = exit_ceiling - price - RESERVE_EUR - required
    weight = F.when(confidence == "high", 1.0).when(confidence == "medium", 0.75).otherwise(0.5)
    return dict(
        adverse_resale_ceiling_eur=exit_ceiling,
        minimum_required_net_margin_eur=required,
        remaining_cost_budget_eur=budget,
        passes_necessary_budget=budget > 0,
        priority_score=F.bround(F.try_divide(F.greatest(F.lit(0), budget), price) * weight, 6),
    )


def hp_kw_conflict(hp: Column, kw: Column) -> Column:
    return F.coalesce(F.abs(hp - kw * F.lit(1.35962)) > 2, F.lit(False))


def ceil_bps(value: Column, bps: Column | int) -> Column:
    """Share in basis points, rounded up, on whole cents."""
    return F.floor((value * bps + 9999) / F.lit(10000)).cast("bigint")
