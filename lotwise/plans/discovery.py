"""Broad discovery: approximate asking signals over all current listings, never an approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as ident, money, scoring, text as tx
from ..functions.damage import with_damage
from ..functions.terms import amount_usable
from ..operators import broad, peers, predicates, stats
from ..operators.temporal import pick_first
from ..session import cut_lineage


def prepare(rows: DataFrame) -> DataFrame:
    """Normal matching columns, damage group and the joined text, computed once per row.

    Fuel and gearbox are matched as stated text, the technical fields after alias and unit
    normalisation.
    """
    d = with_damage(rows).withColumn("body", tx.full_text("title", "description"))
    for name in ("make", "model", "fuel", "transmission"):
        d = d.withColumn(name, tx.squash(name))
    for name in ("generation", "body_type"):
        d = d.withColumn(name, ident.normalize_field(name, name))
    for name in ("displacement_cc", "power_hp"):
        d = d.withColumn(name, ident.normalized_number(name, name))
    return d


def screen_cells(cells: DataFrame) -> DataFrame:
    """Signal and conservative screen of every offer cell that has a signal."""
    d = stats.with_broad_signal(broad.broad_facts(cells))
    screen = stats.conservative_screen(
        F.col("price_eur"), F.col("lowest_close_eur"), F.col("close_count"),
        fuel_known=F.col("fuel").isNotNull() & (F.col("_no_fuel") == 0),
        gearbox_known=F.col("transmission").isNotNull() & (F.col("_no_gear") == 0),
        conflicts=F.lit(False), clean=F.col("damage_group") == "clean",
    )
    return d.withColumns(screen).drop("_no_fuel", "_no_gear")


def discovery_leads(rows: DataFrame, as_of: Column) -> DataFrame:
    """Leads with their signal, score and flags; one per indistinguishable target.

    ``rows`` are the fresh latest listings. Stated text, price terms and damage decide who may be
    a peer; severe damage is neither target nor peer.
    """
    p = prepare(rows)
    usable = cut_lineage(p.filter(
        predicates.identity_present() & amount_usable(F.col("price_eur"), F.col("price_kind"), F.col("body")) & (F.col("damage_group") != "severe")
    ), "usable")
    screened = screen_cells(peers.advert_cells(usable)).filter(F.col("price_eur").between(1000, 20_000) & F.col("apparent_opportunity"))
    facts = screened.select(
        "cell", "comparable_count", "asking_typical_eur", "asking_low_eur", "gross_headroom_eur", "close_count", "lowest_comparable_asking_eur",
        "headroom_after_sale_stress_and_reserve_eur", "minimum_required_net_margin_eur", "blocking_reasons", "price_priority_passed",
    )
    targets = usable.filter(F.col("price_eur").between(1000, 20_000)).withColumn("cell", peers.cell_key(peers.BROAD_CELL))
    leads = targets.join(facts, "cell").drop("cell")
    leads = pick_first(leads, ["make", "model", "year", "mileage_km", "price_eur", "city"], [F.col("source"), F.col("source_id")])
    category = F.col("damage_category")
    judgment = scoring.judgment(
        F.col("price_eur"), F.col("minimum_required_net_margin_eur"), F.col("lowest_comparable_asking_eur"),
        F.col("headroom_after_sale_stress_and_reserve_eur"), F.col("comparable_count"), F.col("close_count"), F.col("price_kind"),
        money.age_days(as_of, "observed_at"), F.col("detail_fetched") if "detail_fetched" in rows.columns else F.lit(False), F.lit(False), category,
    )
    return (
        leads.withColumn("judgment", judgment).withColumn("score", F.col("judgment.score"))
        .withColumn("price_band", money.price_band("price_eur"))
        .withColumn("uncertainty_flags", tx.labels(
            approximate_identity=F.lit(True), exact_variant_comparison_pending=F.lit(True), all_costs_and_resale_unverified=F.lit(True),
            condition_unknown=category == "unknown", location_to_verify=~tx.present("city"),
        ))
    )


def discovery_exclusions(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """Why listings did not become leads, counted by first failing gate."""
    p = prepare(rows)
    gated = p.withColumn("reason", predicates.discovery_exclusion())
    lead_keys = leads.select("source", "source_id").withColumn("_lead", F.lit(True))
    d = gated.join(lead_keys, ["source", "source_id"], "left")
    final = F.coalesce(F.col("reason"), F.when(F.col("_lead").isNull(), F.lit("no_initial_price_signal_or_repeat")))
    return d.select(final.alias("reason")).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def collection_screen(new_rows: DataFrame, memory: DataFrame) -> DataFrame:
    """Which newly seen listings deserve a detail fetch, from the broad signal in one join.

    Every new row comes back with its status; the price memory is read once for all of them.
    """
    new, old = prepare(new_rows), prepare(memory)
    gate = F.coalesce(
        F.when(~amount_usable(F.col("price_eur"), F.col("price_kind"), F.col("body")), F.lit("unusable_price")),
        F.when(F.col("damage_category") == "severe", F.lit("severe_damage")),
        F.when(~predicates.identity_present(), F.lit("missing_search_identity")),
    )
    new = new.withColumn("gate", gate)
    usable = old.filter(
        predicates.identity_present() & amount_usable(F.col("price_eur"), F.col("price_kind"), F.col("body")) & (F.col("damage_group") != "severe")
    )
    # A listing already in memory is not its own peer: drop it there and count it with the new rows.
    others = usable.join(new.select("source", "source_id"), ["source", "source_id"], "left_anti")
    open_rows = new.filter(F.col("gate").isNull())
    cells = peers.advert_cells(others)
    targets = open_rows.select(*peers.BROAD_CELL).distinct()
    cell = peers.cell_key(peers.BROAD_CELL)
    pairs = peers.band_join(
        targets.withColumn("cell", cell), cells.withColumn("cell", cell), ["make", "model", "damage_group"],
        {"year": 3, "mileage_km": 60_000}, peers.broad_compatible(),
    ).groupBy("cell", "price_eur", "year", "mileage_km", "p_year", "p_mileage_km", "p_price_eur", "p_city").agg(
        F.min(F.struct("p_first", "p_fuel", "p_transmission")).alias("offer")
    )
    signal = stats.broad_signal(pairs).select("cell", "comparable_count", "asking_typical_eur", "gross_headroom_eur", "apparent_opportunity")
    d = new.withColumn("cell", cell).join(signal, "cell", "left")
    status = (
        F.when(F.col("gate").isin("unusable_price", "severe_damage"), "excluded").when(F.col("gate").isNotNull() | F.col("comparable_count").isNull(), "needs_market_evidence")
        .when(F.col("apparent_opportunity"), "apparent_opportunity").otherwise("not_apparent_opportunity")
    )
    return d.withColumn("screen_status", status).withColumn("detail_fetch_recommended", status == "apparent_opportunity").drop("cell", "body")
