"""Market-wide asking-price screening of all current listings in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import age_days, peer_weight_nano
from ..functions.text import staged
from ..operators import nearby, stats, temporal
from ..operators.predicates import listing_issue
from ..schema import COHORT
from ..session import cut_lineage

PEER_FIELDS = ("source", "source_id", "observed_at", "price_eur", "year", "mileage_km", "province", "condition")


def usable_latest(events: DataFrame, as_of: Column, window_days: int = 30, ties: Sequence[str] = (), validate: bool = True) -> DataFrame:
    """Newest version per listing, then valid, active and fresh ones."""
    latest = temporal.latest_as_of(events, as_of, ties=ties)
    if validate:
        latest = staged(latest, {"_issue": listing_issue(latest, as_of)}).filter(F.col("_issue").isNull()).drop("_issue")
    return temporal.fresh(latest, as_of, window_days)


def asking_benchmarks(
    targets: DataFrame, pool: DataFrame, as_of: Column, *, cohort: Sequence[str] = COHORT, window_days: int = 30, max_dispersion: float = 0.3,
) -> DataFrame:
    """Provincial benchmark; targets it cannot serve get a national one of the same source.

    ``pool`` holds those of the targets that are undamaged with a total price.
    """
    keys = ("source", *cohort)
    options = dict(in_pool=_healthy(), window_days=window_days, max_dispersion=max_dispersion)
    # Used twice, for the served and for the rest: computed once into the shared folder.
    local = cut_lineage(stats.near_benchmark(targets, pool, as_of, keys=(*keys, "province"), **options), "benchmark")
    served = local.filter("benchmark_status = 'benchmark_available'").withColumn("scope", F.lit("province"))
    rest = targets.join(served.select("source", "source_id").hint("merge"), ["source", "source_id"], "left_anti")
    national = stats.near_benchmark(rest, pool, as_of, keys=keys, **options)
    return served.unionByName(national.withColumn("scope", F.lit("national")))


def benchmark_pools(
    rows: DataFrame, as_of: Column, *, match: Sequence[str], serves: Column, tolerant: Sequence[str] = (), window_days: int = 30, max_dispersion: float = 0.3,
) -> DataFrame:
    """Peers of each listing's asking benchmark, counted and summed up: of its province, or of the nation.

    ``rows`` are fresh listings with a total price; those that ``serve`` are the pool. ``match`` columns and the
    province must be equal, ``tolerant`` ones equal or unknown. A listing whose province makes no benchmark
    (too few, too uneven or too dispersed peers) gets the pool of the nation, its province's included.
    """
    pool = rows.filter(serves)
    local = stats.near_benchmark(rows, pool, as_of, keys=(*match, "province"), in_pool=serves, tolerant=tolerant, window_days=window_days, max_dispersion=max_dispersion)
    served = local.filter("benchmark_status = 'benchmark_available'").select(
        "source", "source_id", F.lit("province").alias("scope"), F.col("comparable_count").alias("peer_count"), F.col("envelope_low_eur").alias("low_eur"), F.col("total_price").alias("sum_eur")
    )
    # Read as what is served and as what isn't.
    served = cut_lineage(served, "served")
    rest = rows.join(served.select("source", "source_id").hint("merge"), ["source", "source_id"], "left_anti")
    national = nearby.near_statistics(rest, pool, keys=match, tolerant=tolerant, own=F.when(serves, 1), needs=lambda total: {"low_eur": F.lit(1)})
    return served.unionByName(national.select(
        "source", "source_id", F.lit("national").alias("scope"), F.col("comparable_count").alias("peer_count"), "low_eur", F.col("total_price").alias("sum_eur")
    ))


def _healthy() -> Column:
    """Listings that serve as peers of a benchmark."""
    return (F.col("price_kind") == "total") & (F.col("condition") == "undamaged")


def screening_decision(benchmarks: DataFrame, min_price: int = 1000, max_price: int = 50_000) -> DataFrame:
    """Select targets at least 10 % below the lower quartile, route the rest."""
    ready = F.col("benchmark_status") == "benchmark_available"
    outside = ~F.col("active") | (F.col("price_kind") != "total") | ~F.col("price_eur").between(min_price, max_price)
    cheap = (F.col("p25") - F.col("price_eur")) * 10 >= F.col("p25")
    reason = (
        F.when(outside, "outside_purchase_scope").when(F.col("condition") == "unknown", "condition_unresolved")
        .when(~ready, "insufficient_comparables").when(cheap, "below_asking_market").otherwise("discount_too_small")
    )
    d = benchmarks.withColumn("reason", reason).withColumn("selected", F.col("reason") == "below_asking_market")
    judged = F.col("reason").isin("below_asking_market", "discount_too_small")
    return d.withColumn("discount_fraction", F.when(judged, F.bround((F.col("p25") - F.col("price_eur")) / F.col("p25"), 6))).withColumn(
        "route", F.when(F.col("selected"), "verification").when(F.col("reason").isin("insufficient_comparables", "condition_unresolved"), "enrichment").otherwise("screened_out")
    )


def market_screen(
    events: DataFrame, as_of: Column, *, cohort: Sequence[str] = COHORT, window_days: int = 30, max_dispersion: float = 0.3,
    ties: Sequence[str] = (), validate: bool = True,
) -> DataFrame:
    """Latest versions, strict peers, weighted quartiles and the screening decision."""
    # Every later step starts from these rows; writing them once saves repeated scans of the events.
    targets = cut_lineage(usable_latest(events, as_of, window_days, ties, validate), "latest")
    pool = targets.filter(_healthy()).select(
        *dict.fromkeys(("source", "source_id", "observed_at", "price_eur", "year", "mileage_km", "province", *cohort))
    )
    return screening_decision(asking_benchmarks(targets, pool, as_of, cohort=cohort, window_days=window_days, max_dispersion=max_dispersion))


MILEAGE_BANDS = (("low", 0, 60_000), ("medium", 60_000, 150_000), ("high", 150_000, 2_000_001))


def mileage_band_targets(targets: DataFrame, pool: DataFrame, variant: Sequence[str]) -> DataFrame:
    """Every target once per mileage band, anchored at the band's upper-median mileage.

    The anchor comes from one aggregation per variant and band; bands without a peer keep the
    target's own mileage.
    """
    counted = pool.withColumn("band", _band(F.col("mileage_km"))).groupBy(*variant, "band", "mileage_km").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    w = Window.partitionBy(*variant, "band").orderBy("mileage_km")
    ladder = counted.withColumn("_cum", F.sum("_n").over(w)).withColumn("_tot", F.sum("_n").over(Window.partitionBy(*variant, "band")))
    anchors = ladder.filter(F.col("_cum") > F.floor(F.col("_tot") / 2)).groupBy(*variant, "band").agg(F.min("mileage_km").alias("anchor_km"))
    bands = targets.withColumn("band", F.explode(F.array(*[F.lit(n) for n, _, _ in MILEAGE_BANDS])))
    return bands.join(anchors, [*variant, "band"], "left").withColumn("anchor_km", F.coalesce("anchor_km", "mileage_km"))


def _band(km: Column) -> Column:
    band = F.lit(None).cast("string")
    for name, low, high in MILEAGE_BANDS:
        band = F.when((km >= low) & (km < high), name).otherwise(band)
    return band


def mileage_band_benchmarks(targets: DataFrame, rows: DataFrame, as_of: Column, variant: Sequence[str], match: Sequence[str], **options) -> DataFrame:
    """Benchmark of every target at the anchor of each mileage band, within that band's cars.

    Anchors come from all ``rows``, peers are the undamaged ones with a total price, of which the target
    may be one: near the anchor, in its own band, with the weight of its own distance.
    """
    anchored = mileage_band_targets(targets, rows, variant).withColumn("_own_km", F.col("mileage_km")).withColumn("mileage_km", F.col("anchor_km"))
    away = F.abs(F.col("_own_km") - F.col("anchor_km"))
    there = _healthy() & (_band(F.col("_own_km")) == F.col("band")) & (away <= 20_000)
    pool = rows.filter(_healthy()).withColumn("band", _band(F.col("mileage_km")))
    own = peer_weight_nano(F.lit(0), away, age_days(as_of, "observed_at"))
    out = stats.near_benchmark(anchored, pool, as_of, keys=(*match, "band"), in_pool=there, own=own, group=("source", "source_id", "band"), **options)
    return out.drop("_own_km")


def market_experts(targets: DataFrame, pool: DataFrame, as_of: Column, variant: Sequence[str], **options) -> DataFrame:
    """Provincial, national and damaged benchmarks side by side, one row per target and view.

    ``pool`` holds those of the targets that have a total price.
    """
    views = [("healthy_province", "undamaged", True), ("healthy_national", "undamaged", False), ("damaged_province", "damaged", True)]
    out = None
    for name, condition, local in views:
        keys = (*variant, "province") if local else tuple(variant)
        serves = F.col("condition") == condition
        one = stats.near_benchmark(targets, pool.filter(serves), as_of, keys=keys, in_pool=serves & (F.col("price_kind") == "total"), **options).withColumn("view", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
