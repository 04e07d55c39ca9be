"""Bases and candidates counted from cells against their pairs."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import peers
from lotwise.streaming import incremental

FIELDS = ("source", "source_id", "year", "mileage_km", "price_eur")


@pytest.fixture(scope="module")
def listings(spark):
    """Few places, so that many listings share one; some without a price kind, place or vehicle."""
    return spark.range(300).select(
        F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.col("id").cast("string").alias("source_id"), (F.col("id") % 3).cast("string").alias("make"), F.lit("m").alias("model"),
        F.when(F.col("id") % 17 != 0, 2000 + F.pmod(F.hash("id"), F.lit(6))).cast("bigint").alias("year"), (F.pmod(F.hash("id", F.lit(1)), F.lit(9)) * 15_000).cast("bigint").alias("mileage_km"),
        (F.col("id") % 5).alias("price_eur"), F.when(F.col("id") % 11 != 0, F.when(F.col("id") % 4 == 0, "unknown").otherwise("total")).alias("price_kind"), F.when(F.col("id") % 7 != 0, (F.col("id") % 40).cast("string")).alias("vehicle_id"),
    ).localCheckpoint()


def test_basis_without_pairs(listings):
    serves = F.col("price_kind") == "total"
    pool = listings.filter(serves)
    match = ("source", "make", "model")
    pairs = peers.strict_comparables(listings.select(*FIELDS, "make", "model"), pool.select(*FIELDS, "make", "model"), keys=match)
    columns = ("source", "source_id", "basis_signature", "basis_count")
    want = sorted(map(tuple, incremental.basis_signatures(listings, pairs, FIELDS).select(*columns).collect()))
    near = incremental.near_basis_signatures(listings, pool, FIELDS, match=match, in_pool=serves)
    assert sorted(map(tuple, near.select(*columns).collect())) == want
    assert near.columns == [*listings.columns, "basis_signature", "basis_count"]
    assert "p_source_id" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_without_pairs(listings):
    cohort = ("make", "model", "year", "mileage_km")
    pool = listings.filter("source_id % 3 <> 1")
    want = peers.vehicle_cohort_or_self(listings, pool, cohort).groupBy("source", "source_id").count()
    got = peers.candidate_counts(listings, pool, cohort)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "p_source_id" not in got._jdf.queryExecution().optimizedPlan().toString()
