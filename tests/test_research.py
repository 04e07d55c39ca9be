"""Leads found after pruning are those that every target's whole variant gives, in a table with one hot variant."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lotwise.functions import money
from lotwise.operators import stats
from lotwise.plans import research
from lotwise.schema import PROFILES


@pytest.fixture(scope="module")
def listings(spark):
    rng, seen = random.Random(21), datetime.datetime(2001, 6, 1)
    rows = []
    for i in range(260):
        year, km = rng.randrange(1998, 2004), rng.randrange(20_000, 100_000, 5000)
        price = 9000 + 900 * (year - 1998) - km // 40 + rng.randrange(-900, 900) - (5500 if i % 40 == 1 else 0)
        make = "hot" if i % 4 else rng.choice(["a", "b"])
        text = rng.choice(["bella auto", "unico proprietario", "graffi sul paraurti", "motore fuso, uso ricambi"])
        rows.append(("s", str(i), seen, True, make, "m", "diesel", "manual", "dealer", year, km, price, "total", rng.choice(["x", "y"]), "unknown", "", text, "g", "t", None, "unknown"))
    schema = "source string, source_id string, observed_at timestamp, active boolean, make string, model string, fuel string, transmission string, seller_type string, year long, mileage_km long, price_eur long, price_kind string, city string, condition string, title string, description string, generation string, trim string, version_text string, damage_severity string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("profile", ["strict", "exploratory"])
def test_pruning_loses_no_lead(listings, profile):
    p = PROFILES[profile]
    prepared = research.prepare(listings, profile)
    pairs = research.research_pairs(prepared, profile)
    label = F.coalesce("p_version", "p_trim")
    counts = pairs.filter("near").groupBy("source_id").agg(F.count_distinct(F.struct("p_year", "p_mileage_km", label, "p_price_eur", F.coalesce("p_city", F.lit("")))).alias("comparable_count"))
    context = stats.price_context(pairs, F.col("near")).join(counts, "source_id").filter(F.col("comparable_count") >= p["min_peers"])
    low = money.whole_div(F.col("asking_low_eur") * (100 - p["stress_pct"]), 100)
    d = context.join(listings.select("source_id", "price_eur"), "source_id").withColumn("room", low - F.col("price_eur"))
    d = d.filter((F.col("room") >= p["headroom"]) & (F.col("room") * 100 >= F.col("price_eur") * p["discount_pct"]))
    facts = ("source_id", "comparable_count", "cohort_count", "asking_low_eur", "asking_typical_eur", "method", "confidence")
    plain = lambda df: sorted(tuple(r[c] for c in facts) for r in df.collect())
    expected = plain(d)
    assert plain(research.research_leads(listings, profile)) == expected and expected


def test_only_the_chosen_meet_their_variant(listings):
    prepared = research.prepare(listings, "exploratory")
    chosen = research.near_offers(prepared, "exploratory").filter("comparable_count >= 3").limit(5)
    ids = {r["source_id"] for r in chosen.collect()}
    some = research.research_pairs(prepared, "exploratory", prepared.filter(F.col("source_id").isin(*ids)))
    assert {r["source_id"] for r in some.select("source_id").distinct().collect()} == ids
