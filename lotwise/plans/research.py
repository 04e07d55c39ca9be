"""Strict, exploratory and mixed-damage research screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ident, money, text as tx
from ..functions.damage import risky, with_damage
from ..operators import contexts, peers, predicates, selection
from ..operators.temporal import pick_first
from ..schema import PROFILES
from ..session import cut_lineage

MATCH = ("make", "model", "fuel_key", "gear_key", "seller_key")
TECHNICAL = tuple(f for f in peers.SAME_VARIANT_FIELDS)


def prepare(rows: DataFrame, profile: str) -> DataFrame:
    """Matching keys, variant signature, damage class and the first failing gate of every listing."""
    d = with_damage(rows).withColumn("body", tx.full_text("title", "description")).withColumn("risky", risky(rows))
    if "conflicts" not in d.columns:
        d = d.withColumn("conflicts", F.lit(False))
    d = d.withColumn("reason", predicates.research_exclusion(profile == "opportunities"))
    for name in TECHNICAL:
        value = ident.normalize_field(name, name) if name in d.columns else F.lit(None).cast("string")
        numeric = name in ident.NUMERIC_LIMITS
        d = d.withColumn(name, value.cast("double") if numeric else value)
    return d.withColumns({
        "make": tx.squash("make"), "model": tx.squash("model"), "fuel_key": tx.squash("fuel"), "gear_key": tx.squash("transmission"),
        "seller_key": F.coalesce("seller_type", F.lit("")), "version": tx.squash("version_text"),
        "signature": ident.version_signature(F.col("version_text"), F.col("model"), F.col("year")),
    })


KEEP = ("source", "source_id", "year", "mileage_km", "price_eur", "city", "version", "signature", *MATCH, *TECHNICAL)
SEARCHED = [c for c in KEEP if c not in ("source", "source_id")]


def _offers(prepared: DataFrame, profile: str) -> DataFrame:
    """Listings that may be peers. Two stay per offer, since a target never is its own peer."""
    eligible = prepared.filter(F.col("reason").isNull() | (F.col("reason") == "purchase_outside_test_range"))
    pool = eligible if profile != "opportunities" else eligible.filter("damage_category = 'clean'")
    return pick_first(pool.select(*KEEP), [c for c in KEEP if c not in ("source", "source_id", "signature")], [F.col("source"), F.col("source_id")], keep=2)


def _targets(prepared: DataFrame) -> DataFrame:
    located = F.col("location_issue").isNull() if "location_issue" in prepared.columns else F.lit(True)
    return prepared.filter(F.col("reason").isNull() & located).select(*KEEP)


def near_offers(prepared: DataFrame, profile: str) -> DataFrame:
    """Distinct near offers of every target that has one, and the least of their prices.

    Only offers inside the bands meet a target; version or trim tells offers apart here.
    """
    p = PROFILES[profile]
    return contexts.near_counts(_targets(prepared), _offers(prepared, profile), match=MATCH, attributes=SEARCHED, years=p["years"], km=p["km"])


def _wide_enough(low: Column, profile: str) -> Column:
    """Whether a reference price leaves the required headroom after stress."""
    p = PROFILES[profile]
    room = money.whole_div(low * (100 - p["stress_pct"]), 100) - F.col("price_eur")
    return (room >= p["headroom"]) & (room * 100 >= F.col("price_eur") * p["discount_pct"])


def research_pairs(prepared: DataFrame, profile: str, chosen: DataFrame | None = None) -> DataFrame:
    """Targets (only those ``chosen``, if given) with every peer of the same variant; ``near`` marks those inside the profile's bands."""
    p = PROFILES[profile]
    targets = _targets(prepared)
    if chosen is not None:
        targets = targets.join(chosen.select("source", "source_id"), ["source", "source_id"], "left_semi")
    offers = _offers(prepared, profile)
    right = offers.select(*[F.col(c).alias("p_" + c) for c in offers.columns])
    on = [F.col(k) == F.col("p_" + k) for k in MATCH] + [peers.not_self(), peers.same_variant()]
    near = (F.abs(F.col("p_year") - F.col("year")) <= p["years"]) & (F.abs(F.col("p_mileage_km") - F.col("mileage_km")) <= p["km"])
    return targets.join(right, on).withColumn("near", near)


def research_contexts(prepared: DataFrame, profile: str, chosen: DataFrame | None = None) -> DataFrame:
    """``stats.price_context`` over ``research_pairs``, without a row for each pair."""
    p = PROFILES[profile]
    targets = _targets(prepared)
    if chosen is not None:
        targets = targets.join(chosen.select("source", "source_id"), ["source", "source_id"], "left_semi")
    return contexts.variant_contexts(targets, _offers(prepared, profile), match=MATCH, attributes=SEARCHED, years=p["years"], km=p["km"])


def research_leads(rows: DataFrame, profile: str = "strict") -> DataFrame:
    """Targets with enough analogies whose stressed reference leaves the required headroom.

    A reference never exceeds the least near price, so targets that even this price doesn't serve leave
    before the fit: only the others meet their whole variant.
    """
    p = PROFILES[profile]
    prepared = cut_lineage(prepare(rows, profile), "prepared")
    g = ["source", "source_id"]
    counts = near_offers(prepared, profile).filter((F.col("comparable_count") >= p["min_peers"]) & _wide_enough(F.col("near_low_eur"), profile))
    # Two uses: who meets its variant, and how many offers it is judged by.
    counts = cut_lineage(counts.select(*g, "comparable_count"), "chosen")
    context = research_contexts(prepared, profile, counts)
    leads = prepared.join(context, g).join(counts, g)
    budget = money.feasibility(F.col("price_eur"), F.col("asking_low_eur"), F.col("confidence"))
    leads = leads.withColumns(budget)
    stressed = money.whole_div(F.col("asking_low_eur") * (100 - p["stress_pct"]), 100)
    leads = leads.withColumn("stressed_reference_eur", stressed).withColumn("gross_headroom_eur", F.col("stressed_reference_eur") - F.col("price_eur"))
    if profile == "opportunities":
        leads = leads.filter("passes_necessary_budget")
    return leads.filter(_wide_enough(F.col("asking_low_eur"), profile)).withColumn("price_band", money.price_band("price_eur")).withColumn(
        "headroom_ratio", F.col("gross_headroom_eur") / F.col("price_eur")
    )


def research_selection(leads: DataFrame, profile: str = "strict", limit: int = 20) -> DataFrame:
    """Balanced shortlist: damage quotas for opportunities, equal band turns otherwise."""
    if profile == "opportunities":
        return selection.damage_mix_selection(leads, limit)
    return selection.round_robin_bands(leads, "headroom_ratio", limit)
