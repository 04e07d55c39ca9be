"""Third-party adverts against the market: pessimistic headroom and open blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ident, money, terms, text as tx
from ..functions.damage import with_damage
from ..operators import peers


def prepare(rows: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """Family, variant, normal specs, damage and price terms, once per row and side."""
    d = with_damage(rows).withColumn("body", tx.full_text("title", "description"))
    start = as_of - F.expr(f"interval {int(window_days)} days")
    for name in ("power_hp", "displacement_cc"):
        d = d.withColumn(name, ident.normalized_number(name, name))
    return d.withColumns({
        "variant": ident.variant(F.col("title"), F.col("model"), F.col("version_text"), F.col("drivetrain"), F.col("body_type")),
        "family_make": F.coalesce(tx.squash("make"), F.lit("")), "family_model": ident.family_model("make", "model"),
        "fuel": ident.normalize_field("fuel", "fuel"), "transmission": ident.gearbox("transmission"), "generation": ident.normalize_field("generation", "generation"),
        "version": F.coalesce(tx.squash("version_text"), F.lit("")),
        "fresh": F.coalesce(F.col("active") & F.col("observed_at").between(start, as_of), F.lit(False)),
        "amount_ok": terms.amount_usable(F.col("price_eur"), F.col("price_kind"), F.col("body")),
        "conditional": terms.conditional_price(F.col("body")),
    })


def peer_exclusion() -> Column:
    return tx.first_failure(
        ("inactive_stale_or_future", ~F.col("fresh")),
        ("price_not_total", ~F.coalesce((F.col("price_kind") == "total") & (F.col("price_eur") >= 1000), F.lit(False))),
        ("identity_or_price_terms", ~F.col("amount_ok") | F.col("conditional")),
        ("disclosed_damage", F.col("damage_category").isin("severe", "non_severe", "minimal") | F.coalesce(F.col("condition") == "damaged", F.lit(False))),
    )


def target_exclusion() -> Column:
    return tx.first_failure(
        ("inactive_stale_or_future", ~F.col("fresh")),
        ("vehicle_purchase_service_not_sale", terms.buying_service(F.col("description"))),
        ("outside_purchase_budget", ~F.coalesce(F.col("price_eur").between(1000, 20_000), F.lit(False))),
        ("conditional_or_unusable_price", ~F.col("amount_ok") | F.col("conditional")),
        ("identity_conflict", F.coalesce(F.size("seller_conflicts") > 0, F.lit(False))),
        ("known_severe_damage", F.col("damage_category") == "severe"),
        ("base_identity_or_explicit_km_missing", F.col("make").isNull() | F.col("model").isNull() | F.col("year").isNull() | (F.size("mileage_options") == 0)),
    )


OFFER = ("p_year", "p_mileage_km", "p_price_eur", "p_city_key", "p_version")
SPECS = ("family_make", "family_model", "variant", "fuel", "transmission", "generation", "power_hp", "displacement_cc", "year", "mileage_km")


def third_party_candidates(adverts: DataFrame, market: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """Adverts whose lowest compatible asking leaves the required margin after stress and reserve.

    ``adverts`` carry seller_conflicts and raw_miles. Peers come from the market only; reposts
    count once. Blockers stay listed: nothing here is an approval.
    """
    t = prepare(adverts, as_of, window_days).withColumn("mileage_options", peers.mileage_hypotheses(F.col("mileage_km"), F.col("raw_miles")))
    t = t.withColumn("exclusion", target_exclusion())
    m = prepare(market, as_of, window_days).withColumn("city_key", F.coalesce(tx.squash("city"), F.lit("")))
    m = m.filter(peer_exclusion().isNull())
    # Indistinguishable offers collapse before the join; their first listing represents them.
    cells = m.groupBy(*SPECS, "price_eur", "city_key", "version", "damage_category").agg(F.min(F.struct("source", "source_id")).alias("_k")).select(
        "*", "_k.source", "_k.source_id"
    ).drop("_k")
    target_cols = ["source", "source_id", "price_eur", "mileage_options", *[s for s in SPECS if s != "mileage_km"]]
    pairs = peers.third_party_pairs(t.filter(F.col("exclusion").isNull()).select(*target_cols), cells)
    near = lambda name, tol: F.coalesce(F.abs(F.col(name) - F.col("p_" + name)) <= tol, F.lit(False))
    engine = (
        near("displacement_cc", F.lit(50)) | near("power_hp", peers.power_tolerance(F.col("power_hp"), F.col("p_power_hp")))
        | F.coalesce(F.abs(F.col("variant.litres") - F.col("p_variant.litres")) <= F.lit(0.05), F.lit(False))
    )
    pairs = pairs.withColumn("_full", engine & F.col("p_fuel").isNotNull() & F.col("p_transmission").isNotNull())
    first = F.struct("p_source", "p_source_id", F.col("_full").alias("full"), F.col("p_damage_category").alias("damage"))
    offers = pairs.groupBy("source", "source_id", *OFFER).agg(F.min(first).alias("o"))
    found = offers.groupBy("source", "source_id").agg(
        F.count(F.lit(1)).alias("comparable_count"), F.min("p_price_eur").alias("lowest_comparable_asking_eur"),
        F.min("o.full").alias("_full"), F.max(F.col("o.damage") != "clean").alias("_unclear"),
    ).filter(F.col("comparable_count") >= 3)
    d = t.join(found, ["source", "source_id"])
    low, price = F.col("lowest_comparable_asking_eur"), F.col("price_eur")
    d = d.withColumns({
        "conservative_exit_eur": money.stressed_exit(low), "minimum_required_net_margin_eur": money.required_margin("price_eur"),
        "price_band": money.price_band("price_eur"),
    }).withColumn("maximum_margin_before_unknown_costs_eur", F.col("conservative_exit_eur") - price - money.RESERVE_EUR)
    d = d.filter((F.col("maximum_margin_before_unknown_costs_eur") >= F.col("minimum_required_net_margin_eur")) & ((low - price) * 100 >= low * 20))
    return d.withColumn("blocking_reasons", tx.labels(
        purchase_cash_price_and_availability_to_confirm=F.lit(True), condition_and_hidden_damage_to_inspect=F.lit(True),
        repair_and_operating_cost_bounds_missing=F.lit(True), provider_mileage_units_unresolved=F.col("mileage_km").isNull(),
        engine_or_variant_comparison_incomplete=~(F.col("_full") & F.col("fuel").isNotNull() & F.col("transmission").isNotNull()),
        seller_title_year_not_document_verified=F.lit(True), comparable_condition_not_confirmed=F.col("_unclear"),
        repaired_history_resale_requires_adverse_review=F.col("damage_category") != "clean",
    )).drop("_full", "_unclear")


def top_candidates(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """Best candidates by room before unknown costs."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1..50")
    return candidates.orderBy(F.col("maximum_margin_before_unknown_costs_eur").desc(), F.col("comparable_count").desc(), "source_id").limit(limit)


def exclusion_counts(adverts: DataFrame, market: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """First failing gate of adverts and of market rows, counted by side."""
    t = prepare(adverts, as_of, window_days).withColumn("mileage_options", peers.mileage_hypotheses(F.col("mileage_km"), F.col("raw_miles")))
    a = t.select(F.lit("advert").alias("side"), target_exclusion().alias("reason"))
    b = prepare(market, as_of, window_days).select(F.lit("market").alias("side"), peer_exclusion().alias("reason"))
    return a.unionByName(b).filter(F.col("reason").isNotNull()).groupBy("side", "reason").agg(F.count(F.lit(1)).alias("n"))
