"""Statistics by position against the plan that lists every pair, with a cohort that holds most rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import nearby, peers, stats

AS_OF = datetime.datetime(2001, 6, 30)


@pytest.fixture(scope="module")
def listings(spark):
    rng = random.Random(9)
    rows = []
    for i in range(700):
        make = "hot" if i % 3 else rng.choice(["a", "b", None])
        km = rng.choice([50_000, 50_001, 60_000, 69_999, 70_000, 90_000, rng.randrange(200_000), None])
        seen = AS_OF - datetime.timedelta(days=rng.choice([0, 1, 1, 29]), seconds=rng.choice([0, 12_345]))
        rows.append(("s", str(i), make, rng.choice(["x", "x", None]), rng.choice([2000, 2001, 2002, 2005, None]), km, rng.choice([1000, 1500, 1500, rng.randrange(1, 9000)]), seen, rng.choice(["total", "total", "deposit"]), True))
    return spark.createDataFrame(rows, "source string, source_id string, make string, fuel string, year long, mileage_km long, price_eur long, observed_at timestamp, price_kind string, active boolean").repartition(3)


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in ("source_id", *columns)) for r in df.collect()), key=repr)


def test_benchmark_equals_the_pair_plan(listings):
    total = F.col("price_kind") == "total"
    as_of, options = F.lit("2001-06-30 00:00:00").cast("timestamp"), dict(max_dispersion=2.0)
    pairs = peers.strict_comparables(listings, listings.filter(total), keys=("make",))
    expected = stats.asking_benchmark(listings, pairs, as_of, **options)
    got = stats.near_benchmark(listings, listings.filter(total), as_of, keys=("make",), in_pool=total, **options)
    columns = ("comparable_count", "benchmark_issue", "benchmark_status", "p25", "p50", "p75", "effective_sample_size")
    assert _rows(got, *columns) == _rows(expected, *columns)
    assert {r["benchmark_status"] for r in got.collect()} == {"benchmark_available", "insufficient_data"}
    envelope = pairs.groupBy("source", "source_id").agg(F.min("p_price_eur").alias("envelope_low_eur"), F.max("p_price_eur").alias("envelope_high_eur"))
    both = ("envelope_low_eur", "envelope_high_eur")
    assert _rows(got.filter("comparable_count >= 1"), *both) == _rows(envelope, *both)


def test_envelope_counts_and_flags_equal_the_pair_plan(listings):
    total = F.col("price_kind") == "total"
    pool, near = listings.filter(total), {"year": 2, "mileage_km": 40_000}
    pairs = peers.band_join(listings, pool, ["make"], near, peers.not_self())
    got = stats.near_envelope(listings, pool, keys=("make",), in_pool=total, years=2, km=40_000)
    columns = ("observation_count", "low_eur", "typical_eur", "high_eur", "potential_low_eur", "potential_high_eur")
    assert _rows(got, *columns) == _rows(stats.family_envelope(pairs, ["source", "source_id"]), *columns)
    expected = peers.band_join(listings, pool, ["make"], near, peers.not_self() & peers.all_equal_or_null(["fuel"])).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("comparable_count"), F.sum("p_price_eur").alias("total_price"), F.count_if(F.col("p_fuel").isNull()).alias("unknown"), F.min("p_price_eur").alias("low_eur")
    )
    got = nearby.near_statistics(
        listings, pool, keys=("make",), tolerant=("fuel",), own=F.when(total, 1), years=2, km=40_000, flags={"unknown": F.col("fuel").isNull()}, needs=lambda whole: {"low_eur": F.lit(1)},
    )
    columns = ("comparable_count", "total_price", "unknown", "low_eur")
    assert _rows(got, *columns) == _rows(expected, *columns)


def test_few_peers_have_counts_but_no_prices(listings):
    got = nearby.near_statistics(listings, listings, keys=("make",), own=F.lit(1), needs=nearby.envelope_needs, minimum=50)
    assert {r["low_eur"] is None for r in got.filter("comparable_count < 50").collect()} == {True}
    assert got.filter("comparable_count >= 50 and low_eur is null").count() == 0 and got.filter("comparable_count >= 50").count() > 0


def test_copies_multiply_counts_only(spark, listings):
    """Five copies of every listing: each target has five times the rows of its peers, less itself."""
    copies = listings.crossJoin(spark.range(5)).withColumn("source_id", F.concat("source_id", F.lit("/"), "id")).drop("id")
    near = lambda rows: nearby.near_statistics(rows, rows, keys=("make",), own=F.lit(1), needs=nearby.envelope_needs)
    single = {r["source_id"]: r["comparable_count"] for r in near(listings).collect()}
    for r in near(copies).collect():
        assert r["comparable_count"] == 5 * (single.get(r["source_id"].split("/")[0], 0) + 1) - 1


def test_empty_sides(listings):
    assert nearby.near_statistics(listings.limit(0), listings, keys=("make",), own=F.lit(1), needs=nearby.envelope_needs).count() == 0
    assert nearby.near_statistics(listings, listings.limit(0), keys=("make",), own=F.lit(0), needs=nearby.envelope_needs).count() == 0
