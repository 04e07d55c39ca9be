"""Plans that keep tables which grow off the driver."""

import os

import pytest

from lotwise.catalog import base as b
from lotwise.operators import peers

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables absent")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_band_join_broadcasts_neither_side(spark):
    rows = spark.range(20).selectExpr("id % 2 as k", "id as year")
    df = peers.band_join(rows, rows, ["k"], {"year": 1})
    assert "BroadcastHashJoin" not in plan(df)
    assert df.count() == sum(1 for x in range(20) for y in range(20) if x % 2 == y % 2 and abs(x - y) <= 1)


def test_adverts_broadcast_no_growing_table(spark):
    assert plan(b.asks(spark, SF)).count("SortMergeJoin") == 2
