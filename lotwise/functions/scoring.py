"""Review-priority score of a lead, from 0 to 100; not a probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# Points for each known field.
COMMON_FIELDS = {"fuel": 6, "transmission": 6, "version_text": 4, "seller_type": 3, "city": 3, "description": 4}
TECHNICAL_FIELDS = {"power_hp": 2, "displacement_cc": 2, "generation": 1}
DETAIL_POINTS = 4


def judgment(
    price: Column, required: Column, lowest: Column, headroom: Column, peers: Column, close_peers: Column,
    kind: Column, age: Column, detailed: Column, conflicts: Column, category: Column,
) -> Column:
    """``struct`` of the score, its components and the open flags of one lead."""
    discount = F.when(lowest > 0, F.greatest(F.lit(0.0), F.try_divide(lowest - price, lowest))).otherwise(0.0)
    spare = F.greatest(F.lit(0), F.coalesce(headroom, F.lit(0)))
    price_score = F.least(F.lit(20.0), discount * 40) + F.least(F.lit(15.0), F.try_divide(spare, required) * 10)
    evidence = F.lit(0)
    for name, points in COMMON_FIELDS.items():
        evidence = evidence + F.when(tx.present(name), points).otherwise(0)
    evidence = evidence + F.when(F.coalesce(detailed, F.lit(False)), DETAIL_POINTS).otherwise(0)
    total = F.coalesce(kind == "total", F.lit(False))
    coverage = (
        F.least(F.lit(8.0), F.coalesce(peers, F.lit(0)) * 8 / F.lit(12.0))
        + F.least(F.lit(8.0), F.coalesce(close_peers, F.lit(0)) * 8 / F.lit(6.0))
        + F.when(total, 4).otherwise(0)
    )
    freshness = F.when(age < 0, 0).when(age <= 3, 10).when(age <= 7, 7).when(age <= 14, 4).otherwise(0)
    technical = F.lit(0)
    for name, points in TECHNICAL_FIELDS.items():
        technical = technical + F.when(tx.present(name), points).otherwise(0)
    open_conflicts = F.coalesce(conflicts, F.lit(False))
    unknown_condition = F.coalesce(category == "unknown", F.lit(False))
    penalty = (
        F.when(open_conflicts, 30).otherwise(0) + F.when(unknown_condition, 10).otherwise(0) + F.when(total, 0).otherwise(8)
    )
    raw = price_score + evidence + coverage + freshness + technical - penalty
    return F.struct(
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2).alias("score"),
        F.bround(price_score, 2).alias("low_price_signal"),
        evidence.cast("int").alias("common_field_evidence"),
        F.bround(coverage, 2).alias("comparable_coverage"),
        freshness.cast("int").alias("freshness"),
        technical.cast("int").alias("technical_evidence"),
        penalty.cast("int").alias("uncertainty_penalty"),
        tx.labels(
            identity_conflicts_to_resolve=open_conflicts,
            condition_unknown_not_assumed_clean=unknown_condition,
            total_purchase_price_to_confirm=~total,
            observation_time_unusable=age.isNull() | (age < 0),
        ).alias("flags"),
    )
