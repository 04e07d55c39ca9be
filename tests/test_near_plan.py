"""Steps that meet peers shuffle visits, not pairs, and versions are ranked before they meet their part."""

import re

from pyspark.sql import functions as F

from lotwise.catalog import base as b
from lotwise.operators import nearby, temporal

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_summed_up_where_they_meet(spark):
    rows = spark.range(300).select(
        F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.lit("hot").alias("make"), (F.col("id") % 3 + 2000).alias("year"),
        (F.col("id") * 100).alias("mileage_km"), (F.col("id") * 7 + 1).alias("price_eur"),
    )
    got = nearby.near_statistics(rows, rows, keys=("make",), own=F.lit(1), needs=nearby.median_needs)
    assert not re.search(r"hashpartitioning\([^)]*_price", _plan(got))
    first = got.filter("source_id = '0'").collect()[0]
    assert (first["comparable_count"], first["low_eur"], first["high_eur"]) == (133, 8, 200 * 7 + 1 - 7)


def test_prices_below_zero_count(spark):
    rows = spark.createDataFrame([("s", "1", "a", 2000, 10, -5), ("s", "2", "a", 2000, 10, -9), ("s", "3", "a", 2001, 10, 4)], "source string, source_id string, make string, year long, mileage_km long, price_eur long")
    got = nearby.near_statistics(rows, rows, keys=("make",), own=F.lit(1), needs=nearby.envelope_needs)
    assert {(r["source_id"], r["low_eur"], r["high_eur"]) for r in got.collect()} == {("1", -9, 4), ("2", -5, 4), ("3", -9, -5)}


def test_newest_versions_are_found_before_parts_are_joined(spark):
    got = b.latest(spark, SF)
    expected = temporal.latest_as_of(b.asks(spark, SF), b.as_of(), ties=b.TIES)
    assert got.columns == expected.columns and got.count() == expected.count() > 0
    assert got.exceptAll(expected).count() == 0
    plan = _plan(got)
    assert plan.index("p_partkey") < plan.index("Window")
    assert "p_partkey" not in plan[plan.index("Window"):plan.index("WindowGroupLimit")]
