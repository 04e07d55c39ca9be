"""Price contexts by blocks of cases are those of every pair: copies, reposts, own offers, several families and blocks."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.operators import contexts, stats
from lotwise.plans import research


@pytest.fixture(scope="module")
def prepared(spark):
    rng, seen = random.Random(4), datetime.datetime(2001, 6, 1)
    rows = []
    for i in range(330):
        if i % 3 == 2:  # a copy of the listing before, by another seller of the same advert
            rows.append((*rows[-1][:1], f"{i}", *rows[-1][2:]))
            continue
        year, km = rng.randrange(1998, 2004), rng.randrange(20_000, 100_000, 5000)
        price = 9000 + 900 * (year - 1998) - km // 40 + rng.randrange(-900, 900)
        version = rng.choice(["1.2 easy", "1.2 easy", None])
        rows.append((rng.choice("st"), str(i), seen, True, "hot" if i % 5 else "b", "m", "diesel", "manual", "dealer", year, km, price, "total", rng.choice(["x", None]), "unknown", "", "bella auto", rng.choice(["g", "g", None]), "t", version, "unknown"))
    schema = "source string, source_id string, observed_at timestamp, active boolean, make string, model string, fuel string, transmission string, seller_type string, year long, mileage_km long, price_eur long, price_kind string, city string, condition string, title string, description string, generation string, trim string, version_text string, damage_severity string"
    return research.prepare(spark.createDataFrame(rows, schema).repartition(3), "exploratory").localCheckpoint()


@pytest.mark.parametrize("block,figures", [(1024, 1 << 18), (7, 500)])
def test_blocks_equal_all_pairs(prepared, monkeypatch, block, figures):
    monkeypatch.setattr(contexts, "BLOCK_CASES", block)
    # Steps of a case or two, so that a block takes several.
    monkeypatch.setattr(contexts, "STEP_FIGURES", figures)
    facts = ("source", "source_id", "cohort_count", "context_count", "method", "confidence", "asking_low_eur", "asking_typical_eur", "asking_high_eur", "validation_error_eur", "euro_per_newer_year", "euro_per_extra_10000_km")
    plain = lambda df: sorted((tuple(r[c] for c in facts) for r in df.collect()), key=repr)
    want = plain(stats.price_context(research.research_pairs(prepared, "exploratory"), F.col("near")))
    assert plain(research.research_contexts(prepared, "exploratory")) == want
    assert {r[4] for r in want} == {"archive_trained_year_mileage", "unadjusted_comparables"}


def test_copies_of_an_offer(spark, prepared):
    """Two hundred listings of one offer are three cases: the two that may stand for it, and the rest."""
    many = prepared.filter("make = 'hot'").limit(1).withColumn("source_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda n: n.cast("string"))))
    targets, offers = research._targets(many), research._offers(many, "exploratory")
    attributes = [c for c in research.KEEP if c not in ("source", "source_id")]
    out = contexts.variant_contexts(targets, offers, match=research.MATCH, attributes=attributes, years=2, km=40_000)
    assert offers.count() == 2 and out.select("cohort_count").distinct().count() == 1 and out.count() == 200
    own = pd.DataFrame({"case": ["a", "b", "c"], "own": ["1", "2", None], "year": 2000, "mileage_km": 10_000})
    pair = pd.DataFrame({"key": ["1", "2"], "lead": ["1", "1"], "p_year": 2000, "p_mileage_km": 10_000, "p_price_eur": [5000, 5000]})
    assert list(contexts._judged(own, pair, 2, 40_000)["context_count"]) == [1, 1, 1]


def test_median_of_masked_values():
    got = contexts._middle(np.array([[3.0, 1.0, 9.0, 2.0], [5.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0]]), np.array([[1, 1, 0, 1], [1, 0, 0, 0], [0, 0, 0, 0]], bool))
    assert list(got[:2]) == [2.0, 5.0] and np.isnan(got[2])


@pytest.mark.parametrize("profile", ["strict", "exploratory"])
def test_near_counts_equal_distinct_pairs(prepared, profile):
    pairs = research.research_pairs(prepared, profile).filter("near")
    offer = F.struct("p_year", "p_mileage_km", F.coalesce("p_version", "p_trim").alias("label"), "p_price_eur", "p_city")
    # collect_set keeps a struct that holds a null.
    want = pairs.groupBy("source", "source_id", "price_eur").agg(F.size(F.collect_set(offer)).alias("comparable_count"), F.min("p_price_eur").alias("near_low_eur"))
    plain = lambda d: sorted(tuple(r[c] for c in ("source", "source_id", "price_eur", "comparable_count", "near_low_eur")) for r in d.collect())
    assert plain(research.near_offers(prepared, profile)) == plain(want) and want.count() > 100
