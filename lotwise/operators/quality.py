"""Coverage, status and usage aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present

QUALITY_FIELDS = (
    "title", "description", "make", "model", "version_text", "generation", "trim", "fuel", "transmission", "year",
    "mileage_km", "price_eur", "province", "seller_type",
)


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    """How often each reason occurs; NULL reasons are rows that passed."""
    return rows.filter(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _unpivot(totals: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{n}', `_{n}`" for n in names)
    return totals.selectExpr(*keep, f"stack({len(names)}, {pairs}) as (field, usable)")


def coverage(rows: DataFrame, fields: Sequence[str], usable: str = "nonblank") -> DataFrame:
    """Usable and missing count per field in one pass over the rows."""
    test = present if usable == "present" else (lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False)))
    totals = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(test(f)).alias(f"_{f}") for f in fields])
    return _unpivot(totals, fields, ["total"]).select("field", "usable", (F.col("total") - F.col("usable")).alias("missing"))


def photo_coverage(rows: DataFrame) -> DataFrame:
    links = F.coalesce(F.size("image_urls"), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("listings"), F.count_if(links > 0).alias("listings_with_photos"),
        F.coalesce(F.sum(F.greatest(links, F.lit(0))), F.lit(0)).alias("photo_links"),
    )


def identity_quality(fields: DataFrame) -> DataFrame:
    """Per identity field: values present, gaps recovered from the original, open conflicts."""
    return fields.groupBy("field").agg(
        F.count_if(F.col("value").isNotNull()).alias("present"),
        F.count_if(F.col("recovery_status") == "normalization_gap").alias("recovered_gaps"),
        F.count_if(F.col("status") == "conflict").alias("conflicts"),
    )


def market_status(events: DataFrame, projected: DataFrame, reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events not projected yet, projection issues by text, and the number of reviews."""
    waiting = events.join(projected.select(*keys), list(keys), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    issues = reason_counts(projected, "issue")
    done = reviews.agg(F.count(F.lit(1)).alias("n"))
    return (
        waiting.select(F.lit("unprojected_events").alias("measure"), "n")
        .unionByName(issues.select(F.concat(F.lit("issue: "), "reason").alias("measure"), "n"))
        .unionByName(done.select(F.lit("reviews").alias("measure"), "n"))
    )


def state_counts(jobs: DataFrame, batch: str, state: str, states: Sequence[str]) -> DataFrame:
    """Jobs per batch and state, one column per state."""
    return jobs.groupBy(batch).agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(state) == s).alias(f"state_{s.lower()}") for s in states]
    )


def usage_ledger(reservations: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows used per month: what a finished import returned, or the reserved cap until then.

    ``reservations`` has run_id, reserved_at, cap; ``imports`` has run_id, finished, rows.
    """
    done = imports.filter("finished").groupBy("run_id").agg(F.sum("rows").alias("actual"))
    return (
        reservations.join(done, "run_id", "left")
        .groupBy(F.date_format("reserved_at", "yyyy-MM").alias("month"))
        .agg(F.sum(F.coalesce("actual", "cap")).cast("bigint").alias("used_rows"), F.count_if(F.col("actual").isNull()).alias("open_reservations"))
    )


def unique_listings(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct listings per source, exact or by sketch."""
    count = F.approx_count_distinct("source_id") if approximate else F.countDistinct("source_id")
    return events.groupBy("source").agg(count.alias("unique_listings"))


def revision_fingerprint(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, newest time and their hash: unchanged means there is no new work."""
    g = events.groupBy(*by) if by else events.groupBy()
    stamp = F.date_format("max_observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return g.agg(F.count(F.lit(1)).alias("events"), F.max("observed_at").alias("max_observed_at")).withColumn(
        "fingerprint", F.sha2(F.concat_ws("|", F.col("events").cast("string"), stamp), 256)
    )


def unchanged_since(current: DataFrame, saved: DataFrame, by: Sequence[str]) -> DataFrame:
    """Which parts may skip their report because the saved fingerprint still holds."""
    before = saved.select(*by, F.col("fingerprint").alias("_saved"))
    return current.join(before, list(by), "left").withColumn(
        "skip", F.coalesce(F.col("fingerprint") == F.col("_saved"), F.lit(False))
    ).drop("_saved")


def zero_yield_runs(batches: DataFrame, order: str, group: Sequence[str] = ()) -> DataFrame:
    """Consecutive non-empty batches without a new listing; five in a row pause a campaign.

    ``batches`` holds one row per batch of a campaign: returned and new_unique counts.
    """
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(order)
    zero = (F.col("returned") > 0) & (F.col("new_unique") == 0)
    marked = batches.withColumn("_z", zero).withColumn("_island", F.sum(F.when(~F.col("_z"), 1).otherwise(0)).over(w))
    run = Window.partitionBy(*(group or []), "_island").orderBy(order)
    return (
        marked.withColumn("zero_yield_batches", F.sum(F.when(F.col("_z"), 1).otherwise(0)).over(run).cast("bigint"))
        .withColumn("pause", F.col("zero_yield_batches") >= 5).drop("_z", "_island")
    )


def new_unique_per_batch(events: DataFrame, batch: Column, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Rows and first-seen listings of every batch."""
    tagged = events.withColumn("batch", batch)
    first = tagged.groupBy(*keys).agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("new_unique"))
    rows = tagged.groupBy("batch").agg(F.count(F.lit(1)).alias("returned"))
    return rows.join(first, "batch", "left").fillna(0, ["new_unique"])
