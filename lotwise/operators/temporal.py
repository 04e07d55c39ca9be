"""Versions of a listing in time: latest, first, changes, history and page chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranked

KEY = ("source", "source_id")


def pick_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """First ``keep`` rows per key in a stated order.

    A rank filter is applied to every input partition before the shuffle, so however many
    versions or copies a key has, at most ``keep`` rows per task of it travel.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= keep).drop("_rank")


def newest(ties: Sequence[str] = ()) -> list[Column]:
    """Order that puts the newest version first; tie columns prefer the higher value."""
    return [F.col("observed_at").desc(), *[F.col(t).desc() for t in ties]]


def latest_as_of(
    events: DataFrame, as_of: Column, keys: Sequence[str] = KEY, ties: Sequence[str] = ()
) -> DataFrame:
    """Newest version per key not later than ``as_of``. Filter only afterwards: a removal or a
    broken newer version retires the older good one."""
    return pick_first(events.filter(F.col("observed_at") <= as_of), keys, newest(ties))


def fresh(latest: DataFrame, as_of: Column, window_days: int = 30) -> DataFrame:
    """Active rows whose newest version lies inside the analysis window."""
    start = as_of - F.expr(f"interval {int(window_days)} days")
    return latest.filter(F.col("active") & (F.col("observed_at") >= start) & (F.col("observed_at") <= as_of))


def not_yet_projected(events: DataFrame, projected: DataFrame, keys: Sequence[str] = KEY + ("observed_at",)) -> DataFrame:
    """Events absent from a derived table, in whatever order they arrived."""
    return events.join(projected.select(*keys), list(keys), "left_anti")


def with_cached_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], withhold_source: str) -> DataFrame:
    """Left join of extracted facts; rows of one source wait until their facts exist."""
    marked = facts.withColumn("_has_facts", F.lit(True))
    joined = rows.join(marked, list(keys), "left")
    return joined.filter((F.col("source") != withhold_source) | F.col("_has_facts")).drop("_has_facts")


def price_changes(history: DataFrame, ties: Sequence[str] = (), keys: Sequence[str] = KEY) -> DataFrame:
    """Consecutive confirmed total prices of one listing that differ.

    Versions are ordered inside one hour of one key, and each hour hands its closing state to
    the next, so even a key that holds a large share of all versions is many small tasks.
    """
    base = history.withColumn("_hour", F.date_trunc("hour", "observed_at"))
    state = F.struct("price_eur", "price_kind")
    inside = Window.partitionBy(*keys, "_hour").orderBy("observed_at", *ties)
    stepped = base.withColumn("_prev", F.lag(state).over(inside)).withColumn("_n", F.row_number().over(inside))
    closing = base.groupBy(*keys, "_hour").agg(F.max_by(state, F.struct("observed_at", *ties)).alias("_close"))
    by_hour = Window.partitionBy(*keys).orderBy("_hour")
    opening = closing.select(*keys, "_hour", F.lag("_close").over(by_hour).alias("_open"))
    prev = F.when(F.col("_n") == 1, F.col("_open")).otherwise(F.col("_prev"))
    return (
        stepped.join(opening, [*keys, "_hour"])
        .withColumn("_prev", prev)
        .filter((F.col("_prev.price_kind") == "total") & (F.col("price_kind") == "total"))
        .filter(F.col("_prev.price_eur") != F.col("price_eur"))
        .select(
            *keys, "observed_at",
            F.col("_prev.price_eur").alias("previous_price_eur"), "price_eur",
            (F.col("price_eur") - F.col("_prev.price_eur")).alias("delta_eur"),
        )
    )


def recent_history(events: DataFrame, ties: Sequence[str] = (), window: int = 100, keys: Sequence[str] = KEY) -> DataFrame:
    """Newest ``window`` versions per key with the total count and a truncation flag."""
    totals = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("observation_count"))
    w = Window.partitionBy(*keys).orderBy(*newest(ties))
    recent = events.withColumn("newest_rank", F.row_number().over(w)).filter(F.col("newest_rank") <= window)
    return recent.join(totals, list(keys)).withColumn(
        "history_truncated", F.col("observation_count") > window
    )


def page_chain_issues(pages: DataFrame) -> DataFrame:
    """First broken rule per page: start cursor, continuation, advance, completion and scope.

    The previous page is found by an equi-join on (run, sequence), so a run of any length
    spreads over all tasks.
    """
    fields = ("next_cursor", "mode", "scope", "complete")
    before = pages.select(
        "source", "run_id", (F.col("sequence") + 1).alias("sequence"), F.struct(*fields).alias("_p")
    )
    p = pages.join(before, ["source", "run_id", "sequence"], "left")
    first = F.col("sequence") == 1
    same_setup = F.col("mode").eqNullSafe(F.col("_p.mode")) & F.col("scope").eqNullSafe(F.col("_p.scope"))
    issue = F.coalesce(
        F.when(F.col("complete") != F.col("next_cursor").isNull(), F.lit("completion_and_cursor_disagree")),
        F.when(first & F.col("input_cursor").isNotNull(), F.lit("first_page_has_cursor")),
        F.when(~first & F.col("_p").isNull(), F.lit("sequence_gap")),
        F.when(F.col("_p.complete"), F.lit("page_after_completion")),
        F.when(~first & ~same_setup, F.lit("configuration_changed")),
        F.when(~first & ~F.col("input_cursor").eqNullSafe(F.col("_p.next_cursor")), F.lit("cursor_not_continued")),
        F.when(~F.col("complete") & F.col("next_cursor").eqNullSafe(F.col("input_cursor")), F.lit("cursor_did_not_advance")),
    )
    return p.withColumn("issue", issue).drop("_p")


def run_status(pages: DataFrame) -> DataFrame:
    """State of the newest page and the totals of every run, in one aggregation."""
    return pages.groupBy("source", "run_id").agg(
        F.max_by(F.struct("mode", "next_cursor", "complete"), F.col("sequence")).alias("last"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("accepted").alias("accepted"),
        F.sum("rejected").alias("quarantined"),
    ).select("source", "run_id", "last.mode", "last.next_cursor", "last.complete", "pages", "accepted", "quarantined")


def holdout_split(cohort: DataFrame, group: Sequence[str], every: int = 5) -> DataFrame:
    """Mark every fifth row in hash order of the listing key as validation."""
    key = F.sha2(F.concat(F.lit("('"), F.col("source"), F.lit("', '"), F.col("source_id"), F.lit("')")), 256)
    placed = ranked(cohort.withColumn("_key", key), list(group), [F.col("_key"), F.col("source"), F.col("source_id")], "_place")
    return placed.withColumn("held_out", (F.col("_place") - 1) % every == 0).drop("_key", "_place")


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: int = 50) -> DataFrame:
    """Rows at evenly spaced ranks plus both ends; groups within ``size`` stay whole."""
    placed = ranked(df, list(group), order, "_i", "_n").withColumn("_i", F.col("_i") - 1)
    last = F.lit(size - 1)
    # Rank i is kept when some step s gives round_half_even(s * (n - 1) / (size - 1)) = i.
    near = F.floor(F.try_divide(F.col("_i") * last, F.col("_n") - 1))
    steps = [near - 1, near, near + 1, near + 2]
    hit = F.lit(False)
    for s in steps:
        hit = hit | ((s >= 0) & (s <= size - 1) & (F.bround(s * (F.col("_n") - 1) / last) == F.col("_i")))
    return placed.filter((F.col("_n") <= size) | hit).withColumn("sample_rank", F.col("_i")).drop("_i", "_n")
