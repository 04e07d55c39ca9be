"""Cards, previews, audits and joined reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text as tx
from ..operators import dedup, temporal
from ..operators.predicates import CARD_FIELDS, filter_cards

KEY = ["source", "source_id"]


def candidate_cards(runs: DataFrame, latest: DataFrame, as_of: Column, filters: Mapping[str, object] | None = None, hours: int = 24) -> DataFrame:
    """Newest analysis per listing, at most a day old, routed to verification and still current."""
    newest = temporal.pick_first(runs, KEY, [F.col("finished_at").desc(), F.col("run_id").desc()])
    recent = newest.filter(F.col("as_of").between(as_of - F.expr(f"interval {int(hours)} hours"), as_of) & (F.col("route") == "verification"))
    current = latest.filter("active").select(*KEY, "observed_at")
    return filter_cards(recent.join(current, [*KEY, "observed_at"], "left_semi"), filters or {})


def rank_cards(cards: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """Ready candidates first, then proven margins, then gross potential; one requested page."""
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("invalid pagination")
    margin = F.col("conservative_margin_low_cents")
    merit = F.when(margin.isNotNull(), margin).otherwise(F.coalesce("potential_gross_low_cents", F.lit(0)))
    ready = F.coalesce(F.col("professional_policy_ready"), F.lit(False))
    return cards.orderBy(ready.desc(), margin.isNotNull().desc(), merit.desc(), F.col("observed_at").desc(), "source", "source_id").offset(offset).limit(limit)


def publication_preview(jobs: DataFrame, latest: DataFrame, as_of: Column) -> DataFrame:
    """Latest job per listing with every reason it cannot be published; an empty list passes.

    ``jobs``: batch_id, source, source_id, observed_at, job_id, state, run_as_of, price_eur,
    supervisor_ok, gate_open, forecast_profit_cents, forecast_profit_low_cents,
    stressed_margin_cents, review_blockers.
    """
    newest = temporal.pick_first(jobs, ["batch_id", *KEY], [F.col("job_id").desc()])
    now = latest.select(*KEY, F.col("observed_at").alias("_seen"), F.col("active").alias("_active"))
    d = newest.join(now, KEY, "left")
    day = lambda c: c.between(as_of - F.expr("interval 24 hours"), as_of)
    required = money.required_margin("price_eur") * 100
    current = F.coalesce(F.col("_active") & (F.col("_seen") == F.col("observed_at")), F.lit(False))
    no = F.lit(False)
    own = tx.labels(
        analysis_not_completed=(F.col("state") != "done") | F.col("run_as_of").isNull(),
        supervisor_approval_missing=~F.coalesce(F.col("supervisor_ok"), no),
        publication_gate_closed=~F.coalesce(F.col("gate_open"), no),
        analysis_older_than_24_hours=~F.coalesce(day(F.col("run_as_of")), no),
        source_removed_or_superseded=~current,
        source_older_than_24_hours=current & ~F.coalesce(day(F.col("_seen")), no),
        forecast_profit_unavailable=~F.coalesce(F.col("forecast_profit_cents") >= required, no),
        forecast_lower_bound_unavailable=~F.coalesce(F.col("forecast_profit_low_cents") >= required, no),
        stressed_margin_insufficient=~F.coalesce(F.col("stressed_margin_cents") >= required, no),
    )
    reasons = F.concat(own, F.coalesce("review_blockers", F.array().cast("array<string>")))
    return d.withColumn("reasons", reasons).withColumn("publishable", F.size("reasons") == 0).drop("_seen", "_active")


def collection_audit(events: DataFrame, listings: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Per listing: versions, price changes and photos shared with other listings."""
    changes = temporal.price_changes(events, ties).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("price_change_count"), F.sum("delta_eur").alias("net_change_eur")
    )
    versions = events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("observation_count"), F.max("observed_at").alias("last_seen"))
    shared = dedup.repost_signals(listings, KEY)
    d = versions.join(changes, KEY, "left").join(shared, KEY, "left")
    return d.fillna(0, ["price_change_count", "net_change_eur", "shared_photo_count", "widest_use"]).withColumn(
        "history_truncated", F.col("observation_count") > 100
    )


def filter_report(candidates: DataFrame, price_band: int | None = None, damage_category: str | None = None) -> DataFrame:
    """Stored candidates of one price band or damage category."""
    out = candidates
    if price_band is not None:
        if price_band not in range(4):
            raise ValueError("price_band must be 0..3")
        out = out.filter(F.col("price_band") == price_band)
    if damage_category is not None:
        out = out.filter(F.col("damage_category") == damage_category)
    return out


def report_execution(reports: DataFrame, jobs: DataFrame, photos: DataFrame) -> DataFrame:
    """Candidates of the newest report with their newest job state and archived photos.

    ``reports``: run_id, as_of and candidate columns, one row per candidate.
    """
    newest = reports.groupBy().agg(F.max(F.struct("as_of", "run_id")).alias("_n")).select(F.col("_n.run_id").alias("run_id"))
    rows = reports.join(F.broadcast(newest), "run_id", "left_semi")
    job = temporal.pick_first(jobs, KEY, [F.col("attempt").desc(), F.col("job_id").desc()]).select(*KEY, "job_id", "state", "attempt")
    manifest = photos.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("photo_references"), F.count_if(F.col("sha").isNotNull()).alias("archived_photos"), F.countDistinct("sha").alias("distinct_assets")
    )
    return rows.join(job, KEY, "left").join(manifest, KEY, "left").fillna(0, ["photo_references", "archived_photos", "distinct_assets"])


__all__ = ["CARD_FIELDS", "candidate_cards", "collection_audit", "filter_report", "publication_preview", "rank_cards", "report_execution"]
