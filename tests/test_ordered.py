"""Ranks, running sums and order statistics against plain sorting, over several partitions and with hot values."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import evaluation, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([0, 0, 0, rng.randrange(1000), None]), rng.randrange(50)) for i in range(3000)]
    return spark.createDataFrame(data, "id long, g string, v long, size long").repartition(5)


def _groups(rows, group):
    out = {}
    for r in rows.collect():
        out.setdefault(r["g"] if group else 0, []).append(r)
    return out


@pytest.mark.parametrize("group", [[], ["g"]])
def test_ranks_and_running_sums(rows, group):
    order = [F.col("v").desc(), F.col("id")]
    got = {r["id"]: (r["place"], r["n"]) for r in ordered.ranked(rows, group, order, "place", "n").collect()}
    sums = {r["id"]: (r["upto"], r["whole"]) for r in ordered.running(rows, group, order, "size", "upto", "whole").collect()}
    assert len(got) == len(sums) == 3000
    for members in _groups(rows, group).values():
        members.sort(key=lambda r: (r["v"] is None, -(r["v"] or 0), r["id"]))
        upto, whole = 0, sum(r["size"] for r in members)
        for place, r in enumerate(members, 1):
            upto += r["size"]
            assert got[r["id"]] == (place, len(members)) and sums[r["id"]] == (upto, whole)


@pytest.mark.parametrize("group", [[], ["g"]])
def test_order_statistics(rows, group):
    n = F.col("n")
    got = ordered.order_statistics(rows, group, "v", {**ordered.middle(n), "ninetieth": F.ceil(n * 9 / 10), "last": n}).collect()
    expected = _groups(rows, group)
    assert len(got) == len(expected)
    for r in got:
        values = sorted(m["v"] for m in expected[r["g"] if group else 0] if m["v"] is not None)
        size = len(values)
        assert (r["n"], r["middle_low"], r["middle_high"], r["last"]) == (size, values[(size - 1) // 2], values[size // 2], values[-1])
        assert r["ninetieth"] == values[-(-size * 9 // 10) - 1]


def test_empty_and_single(rows):
    none = rows.limit(0)
    assert ordered.ranked(none, ["g"], [F.col("id")], "place").count() == 0
    assert ordered.order_statistics(none, ["g"], "v", ordered.middle(F.col("n"))).count() == 0
    assert [tuple(r) for r in ordered.order_statistics(none, [], "v", ordered.middle(F.col("n"))).collect()] == [(None, None, None)]
    one = ordered.ranked(rows.where("id = 7"), [], [F.col("id")], "place", "n").collect()
    assert [(r["place"], r["n"]) for r in one] == [(1, 1)]


def test_error_metrics_equal_exact_percentiles(rows):
    judged = rows.where("v is not null and g is not null").select(
        (F.col("v") + 1000).alias("predicted_cents"), (F.col("size") + 1100).alias("sold_cents"), F.lit(900).alias("interval_low_cents"), F.lit(1900).alias("interval_high_cents"), F.col("g").alias("segment")
    )
    d = judged.withColumn("e", F.col("predicted_cents") - F.col("sold_cents"))
    exact = d.groupingSets([[], [F.col("segment")]], F.col("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.median(F.abs("e") / F.col("sold_cents") * 100), 3).alias("median_ape"),
        F.expr("percentile_disc(0.9) within group (order by abs(e))").cast("bigint").alias("p90_abs_error_cents"), F.expr("percentile_disc(0.9) within group (order by greatest(0, e))").cast("bigint").alias("p90_overpricing_cents"),
    )
    columns = ("segment", "n", "median_ape", "p90_abs_error_cents", "p90_overpricing_cents")
    plain = lambda df: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert plain(evaluation.error_metrics(judged)) == plain(exact)
