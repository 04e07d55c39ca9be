"""Variant peers met in homes against the plan that lists every pair: headlines, labels, bare trims, copies, rows that don't serve."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import identity as ident, text as tx
from lotwise.operators import broad, peers, variant_peers


@pytest.fixture(scope="module")
def listings(spark):
    rng, rows = random.Random(6), []
    for i in range(600):
        if i % 6 == 2:  # a copy of the listing before, which may not serve
            rows.append(("s", str(i), *rows[-1][2:-1], rng.choice(["total", "deposit"])))
            continue
        rows.append((
            rng.choice("st"), str(i), "hot" if i % 5 else rng.choice(["b", None]), "panda", rng.choice(["manual", "manual", None]), rng.choice(["g1", "g1", None]), rng.choice(["t1", "t2", None]), rng.choice([60, 60, 70, None]), rng.choice([1200, 1200, 1300, None]),
            rng.choice(["sedan", None]), rng.choice(["easy", "panda easy", "ii easy", "iii easy", "easy 2001", "Pop", None, None]), rng.choice([1999, 2000, 2001, 2003, None]), rng.choice([0, 39_999, 40_000, 79_999, 80_000, 120_000, None]), rng.choice([1000, 1500, None]), rng.choice(["total", "total", "deposit", None]),
        ))
    schema = "source string, source_id string, make string, model string, transmission string, generation string, trim string, power_hp long, displacement_cc long, body_type string, version_text string, year long, mileage_km long, price_eur long, price_kind string"
    df = spark.createDataFrame(rows, schema).withColumns({"version": tx.squash("version_text"), "signature": ident.version_signature(F.col("version_text"), F.col("model"), F.col("year"))})
    return df.repartition(3).localCheckpoint()


@pytest.mark.parametrize("block", [16_384, 20])
def test_homes_equal_all_pairs(listings, monkeypatch, block):
    monkeypatch.setattr(broad, "BLOCK_TARGETS", block)
    total = F.col("price_kind") == "total"
    pairs = peers.band_join(listings, listings.filter(total), ["make", "transmission"], {"year": 2, "mileage_km": 40_000}, peers.not_self() & peers.same_variant(variant_peers.FIELDS))
    want = pairs.groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("peer_count"), F.min("p_price_eur").alias("low_eur"), F.sum("p_price_eur").alias("sum_eur"))
    plain = lambda d: sorted((tuple(r[c] for c in ("source", "source_id", "peer_count", "low_eur", "sum_eur")) for r in d.collect()), key=repr)
    got = variant_peers.variant_summary(listings, total)
    assert plain(got) == plain(want) and want.count() > 100
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    by_label = pairs.filter("version <> p_version").count()
    bare = pairs.filter("version is null").count()
    assert by_label > 20 and bare > 20


def test_steps_of_a_target(listings, monkeypatch):
    total = F.coalesce(F.col("price_kind") == "total", F.lit(False))
    flat = listings.filter("make = 'hot' and transmission is not null and year is not null and mileage_km is not null")
    flat = flat.select("*", "signature.label", "signature.roman", total.alias("serves")).groupBy(*variant_peers.CELL).agg(F.count(F.lit(1)).alias("copies")).withColumn("cell", peers.cell_key(variant_peers.CELL))
    home = variant_peers._Home(flat.toArrow(), 2, 40_000)
    facts = lambda: sorted((tuple(r.values()) for r in home.facts(np.arange(len(home.table))).to_pylist()), key=repr)
    whole = facts()
    monkeypatch.setattr(broad, "STEP_FIGURES", 3)
    assert facts() == whole and len(whole) > 100
