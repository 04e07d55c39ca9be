"""Order of a run's pages by their cursors, where a batch may hold any part of it in any order.

A page continues the run when its input cursor is where the run stands: the cursor stored last, or
none for a new run. The pages of a batch are a list linked by cursors. Neighbours in the order of page
names that follow one another are one segment; segments are ranked by pointer doubling, so a chain that
the names don't follow takes a number of rounds that is the logarithm of its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.temporal import pick_first
from ..session import cut_lineage

RUN = ("source", "run_id")
PAGE = (*RUN, "page_id", "checksum")


def _place(cursor: Column) -> Column:
    """A cursor as a join key; the start of a run is a place of its own."""
    return F.when(cursor.isNull(), F.lit("")).otherwise(F.concat(F.lit(">"), cursor))


def run_tails(manifest: DataFrame) -> DataFrame:
    """Where each stored run stands: its last page by sequence."""
    last = F.max_by(F.struct("mode", "scope", "next_cursor", "complete"), "sequence")
    return manifest.groupBy(*RUN).agg(last.alias("tail"), F.max("sequence").alias("stored_pages"))


def _setup(mode: Column, scope: Column) -> Column:
    """What must not change within a run; the order of a scope's keys doesn't matter."""
    return F.struct(mode.alias("mode"), F.to_json(F.try_parse_json(scope)).alias("scope"))


def _segments(nodes: DataFrame) -> DataFrame:
    """Nodes with ``segment`` (number within the run) and ``step`` (place in the segment, from 0)."""
    entered = nodes.groupBy(*RUN, F.col("to").alias("at")).agg((F.count(F.lit(1)) > 1).alias("joined"))
    marked = nodes.join(entered, [*RUN, "at"], "left")
    run = Window.partitionBy(*RUN).orderBy(F.length("page_id"), "page_id")
    follows = F.lag("to").over(run).eqNullSafe(F.col("at")) & ~F.coalesce("joined", F.lit(False)) & (F.col("at") != F.col("start"))
    marked = marked.withColumn("segment", F.sum((~follows).cast("bigint")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("step", F.row_number().over(Window.partitionBy(*RUN, "segment").orderBy(F.length("page_id"), "page_id")) - 1).drop("joined")


def _reached(segments: DataFrame) -> DataFrame:
    """Segments that a run's start leads to: run, ``at`` and the number of pages before them."""
    spans = cut_lineage(segments.groupBy(*RUN, "segment").agg(F.min_by("at", "step").alias("at"), F.max_by("to", "step").alias("to"), F.count(F.lit(1)).alias("pages"), F.first("start").alias("start")), "segments")
    reached = spans.where("at = start").select(*RUN, "at", F.lit(0).cast("bigint").alias("before"))
    starts = spans.select(*RUN, F.col("at").alias("to"))
    jumps = cut_lineage(spans.join(starts, [*RUN, "to"], "left_semi").select(*RUN, "at", "to", "pages"), "jumps")
    if jumps.isEmpty():
        return reached
    known = reached.count()
    while True:
        further = reached.join(jumps, [*RUN, "at"]).select(*RUN, F.col("to").alias("at"), (F.col("before") + F.col("pages")).alias("before"))
        # A circle comes back to a segment later; its first place holds.
        reached = cut_lineage(reached.unionByName(further).groupBy(*RUN, "at").agg(F.min("before").alias("before")), "reached")
        if (now := reached.count()) == known:
            return reached
        known = now
        second = jumps.select(*RUN, F.col("at").alias("to"), F.col("to").alias("then"), F.col("pages").alias("more"))
        jumps = cut_lineage(jumps.join(second, [*RUN, "to"]).select(*RUN, "at", F.col("then").alias("to"), (F.col("pages") + F.col("more")).alias("pages")), "jumps")


def continue_runs(pages: DataFrame, tails: DataFrame) -> DataFrame:
    """``pages`` with ``sequence`` of those that continue their run, and ``chain_issue`` of the others.

    ``pages`` are new, sound pages (source, run_id, page_id, checksum, mode, scope, input_cursor,
    next_cursor, complete); ``tails`` is where stored runs stand. A new run starts with a page without
    input cursor. Of several pages that start from one cursor, the one of the least page_id holds and the
    others are refused, as is what follows only them, what no chain reaches, every page with another mode
    or scope than its run, and whatever comes after the page that completes the run.
    """
    d = pages.join(tails, list(RUN), "left").withColumn("setup", _setup(F.col("mode"), F.col("scope")))
    stored = F.col("tail").isNotNull()
    heads = pick_first(d.where(~stored & F.col("input_cursor").isNull()), RUN, [F.col("page_id"), F.col("checksum")]).select(*RUN, F.col("setup").alias("_head"))
    d = d.join(heads, list(RUN), "left")
    expected = F.when(stored, _setup(F.col("tail.mode"), F.col("tail.scope"))).otherwise(F.col("_head"))
    over = F.coalesce(F.col("tail.complete"), F.lit(False))
    issue = F.coalesce(
        F.when(over, F.lit("run already completed")),
        F.when(~stored & F.col("_head").isNull(), F.lit("first page requires a null input cursor")),
        F.when(F.col("setup") != expected, F.lit("run configuration changed")),
    )
    d = d.withColumns({
        "chain_issue": issue, "at": _place(F.col("input_cursor")), "to": F.when(~F.col("complete"), _place(F.col("next_cursor"))),
        "start": F.when(stored, _place(F.col("tail.next_cursor"))).otherwise(F.lit("")), "stored_pages": F.coalesce("stored_pages", F.lit(0)),
    }).drop("tail", "setup", "_head")
    d = cut_lineage(d, "chain")
    chosen = pick_first(d.where("chain_issue is null"), [*RUN, "at"], [F.col("page_id"), F.col("checksum")])
    segments = cut_lineage(_segments(chosen.select(*PAGE, "at", "to", "start")), "segmented")
    first = segments.where("step = 0").select(*RUN, "segment", "at").join(_reached(segments), [*RUN, "at"]).select(*RUN, "segment", "before")
    placed = segments.join(first, [*RUN, "segment"]).select(*PAGE, (F.col("before") + F.col("step") + 1).alias("_place"))
    out = d.join(placed, list(PAGE), "left").withColumn("sequence", (F.col("stored_pages") + F.col("_place")).cast("bigint"))
    refused = F.coalesce("chain_issue", F.lit("page does not continue the saved cursor"))
    return out.withColumn("chain_issue", F.when(F.col("sequence").isNull(), refused)).drop("at", "to", "start", "stored_pages", "_place")
