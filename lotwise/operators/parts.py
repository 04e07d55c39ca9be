"""Parts offers: acceptance, estimate per part, and the repair plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx, urls
from .dedup import newest_offer
from .predicates import bounded_cost_ok, document_ok

# Storefronts that belong to one seller group.
ALIAS_HOSTS = ("auto-doc.it", "autoparti.it", "tuttoautoricambi.it")
ALIAS_SELLERS = ("autodoc", "autodoc se")
ALIAS_GROUP = "autodoc"


def seller_group() -> Column:
    """Independent seller behind an offer."""
    known = urls.bare_host("url").isin(*ALIAS_HOSTS) & F.lower(F.trim("seller")).isin(*ALIAS_SELLERS)
    return F.when(F.coalesce(known, F.lit(False)), ALIAS_GROUP).otherwise(F.lower(F.trim("seller_group")))


def _requirements_met(requirements: Column, attributes: Column) -> Column:
    return F.forall(F.map_keys(requirements), lambda k: F.coalesce(F.try_element_at(attributes, k) == F.try_element_at(requirements, k), F.lit(False)))


def judge_offers(parts: DataFrame, offers: DataFrame, as_of: Column, max_days: int = 14) -> DataFrame:
    """Every offer with ``reason``: NULL when it is usable for its part.

    ``parts``: part_id, quantity, condition, tier, part_number, requirements. ``offers``:
    part_id, url, seller, seller_group, brand, part_number, oem_cross_references, observed_at,
    currency, vat_included, availability, condition, tier, fitment_basis, attributes,
    price_cents, pack_quantity.
    """
    p = parts.select(
        "part_id", "quantity", F.col("condition").alias("_condition"), F.col("tier").alias("_tier"),
        F.lower(F.trim("part_number")).alias("_code"), "requirements",
    )
    code = F.lower(F.trim("part_number"))
    codes = F.concat(F.array(code), F.coalesce(F.transform("oem_cross_references", lambda c: F.lower(F.trim(c))), F.array().cast("array<string>")))
    old = as_of - F.expr(f"interval {int(max_days)} days")
    needs = F.coalesce("requirements", F.create_map().cast("map<string,string>"))
    has = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    reason = tx.first_failure(
        ("public https url required", ~urls.public_https("url")),
        ("stale or future observation", ~F.coalesce(F.col("observed_at").between(old, as_of), F.lit(False))),
        ("currency or VAT unresolved", ~F.coalesce((F.col("currency") == "EUR") & F.col("vat_included"), F.lit(False))),
        ("stock not confirmed", ~F.coalesce(F.col("availability") == "available", F.lit(False))),
        ("different condition", ~F.col("condition").eqNullSafe(F.col("_condition"))),
        ("different tier", ~F.col("tier").eqNullSafe(F.col("_tier"))),
        ("incomplete compatibility", ~tx.present("fitment_basis") | ~_requirements_met(needs, has)),
        ("requested code missing", F.col("_code").isNotNull() & ~F.coalesce(F.array_contains(codes, F.col("_code")), F.lit(False))),
        ("zero price or unknown pack", ~F.coalesce(F.col("price_cents").between(1, 10_000_000) & F.col("pack_quantity").between(1, 100), F.lit(False))),
        ("seller group missing", F.coalesce(F.trim("seller_group") == "", F.lit(True))),
    )
    return (
        offers.join(p, "part_id")
        .withColumn("reason", reason)
        .withColumn("seller_key", seller_group())
        .withColumn("code_key", code)
        .withColumn("cost_cents", (F.ceil(F.col("quantity") / F.col("pack_quantity")) * F.col("price_cents")).cast("bigint"))
        .drop("_condition", "_tier", "_code", "requirements")
    )


def estimate_parts(parts: DataFrame, judged: DataFrame) -> DataFrame:
    """Low, typical and high cost per part; the typical is the median of per-seller medians.

    ``parts`` also carries fallback_low_cents, fallback_high_cents, diagnosis_confirmed and
    identity_confirmed. Uncertain parts widen their range by the fallback envelope.
    """
    usable = judged.filter(F.col("reason").isNull())
    one = newest_offer(usable, ["part_id", "seller_key", F.lower("brand"), "code_key"], "observed_at", "cost_cents", ["url"])
    by_seller = one.groupBy("part_id", "seller_key").agg(
        F.median("cost_cents").alias("_m"), F.count(F.lit(1)).alias("_n"), F.min("cost_cents").alias("_lo"), F.max("cost_cents").alias("_hi"),
        F.min(F.struct(F.col("cost_cents"), F.col("url"))).alias("_cheapest"),
        F.min(F.when(_delivered().isNotNull(), F.struct(_delivered().alias("cents"), F.col("url").alias("url")))).alias("_delivered"),
        F.min((F.col("retrieval") == "live_page") if "retrieval" in one.columns else F.lit(True)).alias("_live"),
    )
    by_part = by_seller.groupBy("part_id").agg(
        F.count(F.lit(1)).alias("independent_sellers"), F.sum("_n").alias("accepted_offers"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.bround(F.median("_m"), 0).cast("bigint").alias("_typical"), F.min("_cheapest").alias("_cheapest"),
        F.min("_delivered").alias("_delivered"), F.min("_live").alias("_live"),
    )
    d = parts.join(by_part, "part_id", "left")
    priced = F.col("_lo").isNotNull()
    sure = F.coalesce((F.col("independent_sellers") >= 2) & F.col("_live") & F.col("diagnosis_confirmed") & F.col("identity_confirmed"), F.lit(False))
    low0, high0 = F.col("fallback_low_cents"), F.col("fallback_high_cents")
    low = F.when(~priced, low0).when(sure, F.col("_lo")).otherwise(F.least(low0, F.col("_lo")))
    high = F.when(~priced, high0).when(sure, F.col("_hi")).otherwise(F.greatest(high0, F.col("_hi")))
    typical = F.when(priced, F.col("_typical")).otherwise(F.floor((low0 + high0) / 2).cast("bigint"))
    return d.select(
        "part_id", F.coalesce("independent_sellers", F.lit(0)).cast("bigint").alias("independent_sellers"),
        F.coalesce("accepted_offers", F.lit(0)).cast("bigint").alias("accepted_offers"),
        low.cast("bigint").alias("parts_low_cents"), F.greatest(low, F.least(typical, high)).cast("bigint").alias("parts_typical_cents"),
        high.cast("bigint").alias("parts_high_cents"),
        F.when(priced, "observed_offers_with_assumptions").otherwise("sourced_analogy").alias("basis"),
        F.when(priced & sure, "observed_price_range").otherwise("wide").alias("uncertainty"),
        F.col("_cheapest.cost_cents").alias("cheapest_cents"), F.col("_cheapest.url").alias("cheapest_url"),
        F.col("_delivered.cents").alias("cheapest_delivered_cents"),
    )


def _delivered() -> Column:
    """Cost with all fees, only when every fee is stated."""
    return F.col("cost_cents") + F.col("shipping_cents") + F.col("bulky_fee_cents") + F.col("core_deposit_cents")


def researched_offers(offers: DataFrame, visited: DataFrame, requests: DataFrame) -> DataFrame:
    """Offers a web research returned, with the reason each unusable one is refused.

    ``visited``: request_id, urls. ``requests``: request_id, part_id, requirements. ``offers`` adds
    compatibility: array of struct<requirement, matches, evidence>.
    """
    d = offers.join(visited, "request_id").join(requests, ["request_id", "part_id"])
    names = F.transform("compatibility", lambda c: c["requirement"])
    met = F.forall(
        F.map_keys("requirements"),
        lambda k: F.exists("compatibility", lambda c: (c["requirement"] == k) & c["matches"] & (F.length(c["evidence"]) > 0)),
    )
    reason = tx.first_failure(
        ("product url was not consulted", ~F.coalesce(urls.public_https("url") & F.array_contains("urls", F.col("url")), F.lit(False))),
        ("compatibility explanation missing", ~tx.present("fitment_basis")),
        ("duplicate compatibility requirements", F.size(F.array_distinct(names)) != F.size(names)),
        ("required compatibility check unresolved", ~F.coalesce(met, F.lit(False))),
    )
    return d.withColumn("reason", reason).drop("urls")


def plan_parts(parts: DataFrame, offers: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """Cheapest compatible all-in offer per planned part."""
    ok = (
        document_ok(as_of, 7) & F.col("fitment_confirmed") & F.col("available") & (F.col("offer_part_number") == F.col("part_number"))
        & F.col("tier").isin("original", "aftermarket") & F.col("condition").isin("new", "used", "remanufactured")
        & (F.col("quantity_covered") == F.col("quantity")) & F.col("shipping_included") & F.col("deposit_included")
        & bounded_cost_ok(as_of) & (F.col("high_cents") > 0)
    )
    d = offers.join(parts, [*keys, "part_id"]).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return d.groupBy(*keys, "part_id", "repair_id").agg(
        F.count_if("_ok").alias("accepted_offers"), F.count_if(~F.col("_ok")).alias("rejected_offers"),
        F.min(F.when(F.col("_ok"), F.struct("high_cents", "seller"))).alias("_best"),
    ).select(*keys, "part_id", "repair_id", "accepted_offers", "rejected_offers", F.col("_best.high_cents").alias("cheapest_all_in_cents"), F.col("_best.seller").alias("cheapest_seller"))


def plan_labour(operations: DataFrame, credits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Effective minutes per vehicle: all operations less the reviewed shared-work credits.

    A credit never exceeds the shortest operation of its group; a shared group of two or more
    operations without a reviewed decision leaves the minutes NULL.
    """
    groups = operations.filter(F.col("shared_group").isNotNull()).groupBy(*keys, "shared_group").agg(
        F.count(F.lit(1)).alias("_members"), F.min("low_minutes").alias("_shortest")
    )
    decided = groups.join(credits, [*keys, "shared_group"], "left")
    valid = F.col("minutes").between(F.lit(0), F.col("_shortest")) & (F.col("_members") >= 2)
    credit = decided.groupBy(*keys).agg(
        F.sum(F.when(valid, F.col("minutes"))).alias("credit_minutes"),
        F.count_if((F.col("_members") >= 2) & ~F.coalesce(valid, F.lit(False))).alias("open_groups"),
    )
    total = operations.groupBy(*keys).agg(F.count(F.lit(1)).alias("operations"), F.sum("high_minutes").alias("total_minutes"), F.collect_set("repair_id").alias("covered_repairs"))
    d = total.join(credit, list(keys), "left").fillna(0, ["credit_minutes", "open_groups"])
    return d.withColumn("effective_minutes", F.when(F.col("open_groups") == 0, F.col("total_minutes") - F.col("credit_minutes")))


def repair_plan(required: DataFrame, parts: DataFrame, labour: DataFrame, quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether quotes cover the planned parts and every diagnosed repair has labour.

    ``required``: keys, required_repairs. ``parts``: output of ``plan_parts``. ``quotes``: keys,
    repair_id, high_cents.
    """
    needed = parts.groupBy(*keys, "repair_id").agg(F.sum("cheapest_all_in_cents").alias("_parts"), F.count_if(F.col("cheapest_all_in_cents").isNull()).alias("_unpriced"))
    per_repair = needed.join(
        quotes.groupBy(*keys, "repair_id").agg(F.count(F.lit(1)).alias("_quotes"), F.max("high_cents").alias("_quoted")), [*keys, "repair_id"], "left"
    )
    short = per_repair.groupBy(*keys).agg(
        F.sum("_parts").alias("parts_cents"), F.sum("_unpriced").alias("unpriced_parts"),
        F.count_if(~F.coalesce((F.col("_quotes") == 1) & (F.col("_quoted") >= F.col("_parts")), F.lit(False))).alias("understated_quotes"),
    )
    d = required.join(short, list(keys), "left").join(labour, list(keys), "left")
    covered = F.size(F.array_except("required_repairs", F.coalesce("covered_repairs", F.array().cast("array<string>")))) == 0
    return d.withColumn("plan_blockers", tx.labels(
        parts_without_complete_offer=F.coalesce(F.col("unpriced_parts"), F.lit(1)) > 0,
        repair_without_labour=~covered,
        shared_work_undecided=F.coalesce(F.col("open_groups"), F.lit(0)) > 0,
        quote_understates_parts=F.coalesce(F.col("understated_quotes"), F.lit(1)) > 0,
    ))
