"""Balanced top-k selection over price bands, families and damage categories.

A choice depends on the choices before it, but there are at most ``limit`` of them. Window ranks on
the full table keep every row that can still be chosen, a small multiple of ``limit``; those become one
row of arrays, and the choice is one fold in which a step looks at one row. Counters of families, offers
and places are part of the fold's state, so a step costs the same whatever was chosen before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DAMAGE_MIX

BANDS = 4
FAMILY = ("make", "model")
#: Largest selection: it bounds the one array that a selection is made from.
MOST_SELECTED = 500


def _checked(limit: int) -> int:
    if not 1 <= limit <= MOST_SELECTED:
        raise ValueError(f"limit must be 1 to {MOST_SELECTED}")
    return limit


def _ranks(df: DataFrame, ranks: dict[str, tuple[Sequence[str], Sequence[Column]]]) -> DataFrame:
    for name, (keys, order) in ranks.items():
        df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return df


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bump(counts: Column, at: Column, when: Column | None = None) -> Column:
    """Counters with the one at a place raised, if ``when`` holds."""
    raised = _let(at, lambda a: F.transform(counts, lambda n, i: F.when(i == a, n + 1).otherwise(n)))
    return raised if when is None else F.when(when, raised).otherwise(counts)


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0), n)


def _numbered(rows: DataFrame, order: Sequence[Column], marks: dict[str, Column]) -> DataFrame:
    """Rows with their place in ``order`` and a whole number for each distinct value of a mark, all from 0."""
    # The rows are bounded by the limit, so windows over all of them are small by construction.
    rows = rows.withColumn("_i", F.row_number().over(Window.orderBy(*order)) - 1)
    for name, value in marks.items():
        rows = rows.withColumn(name, F.dense_rank().over(Window.orderBy(value)) - 1)
    return rows


def _ranked(rows: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    place = F.row_number().over(Window.orderBy(by))
    return rows.join(F.broadcast(chosen), "_i").withColumn("selection_rank", place).drop("_i", "_k")


def _take_turns(rows: DataFrame, order: Sequence[Column], pool: Column, seats: list[int], family_cap: int, fall_back: bool, offer: Column | None = None) -> DataFrame:
    """The rows chosen turn by turn, with selection_rank in order of the turns.

    Groups follow one another, each with its seats and a pool of rows per price band; the bands take
    turns, a round for each seat. A turn takes the first row of its pool of which the offer isn't taken and
    the family is below its cap; with ``fall_back``, else the first of which the offer isn't taken; none
    once the group has its seats. A row passed over is never open again, neither for its family nor for its
    offer, so each pool has one reading place for either search, and they only move on.
    """
    pools = BANDS * len(seats)
    numbered = _numbered(rows, order, {"_family": F.struct(*FAMILY), "_offer": F.col("_i") if offer is None else offer}).withColumn("_pool", pool)
    bounds = numbered.agg(F.coalesce(F.max("_family"), F.lit(-1)).alias("f"), F.coalesce(F.max("_offer"), F.lit(-1)).alias("o"), F.count(F.lit(1)).alias("n"),
                          *(F.sort_array(F.collect_list(F.when(F.col("_pool") == p, F.struct(F.col("_i").alias("i"), F.col("_family").alias("family"), F.col("_offer").alias("offer"))))).alias(f"p{p}") for p in range(pools)))
    places = F.array(*(F.struct(F.lit(g).alias("group"), F.lit(n).alias("seats")) for g, n in enumerate(seats) if n))
    turn = lambda p, k: F.struct((BANDS * p["group"] + k % BANDS).alias("pool"), p["group"].alias("group"), p["seats"].alias("seats"))
    queue = F.flatten(F.transform(places, lambda p: F.transform(F.sequence(F.lit(0), BANDS * p["seats"] - 1), lambda k: turn(p, k))))
    one = bounds.select("f", "o", "n", F.array(*(f"p{p}" for p in range(pools))).alias("pools"), queue.alias("queue"))
    # What every step reads goes along in the state: the optimizer would build it anew inside the fold.
    start = F.struct(
        F.col("pools"), F.col("queue"), F.lit(0).alias("turn"), _zeros(F.lit(pools)).alias("fresh"), _zeros(F.lit(pools)).alias("spare"), _zeros(F.col("f") + 1).alias("families"), _zeros(F.col("o") + 1).alias("offers"),
        _zeros(F.lit(len(seats))).alias("filled"), F.array().cast("array<int>").alias("chosen"),
    )

    def look(s: Column) -> Column:
        """What a step sees: a row that is passed over (is_fresh tells in which search) or taken, or else the end of a turn."""

        def judge(turn: Column, seen: Column) -> Column:
            is_fresh = seen["fresh"].isNotNull()
            row = F.coalesce(seen["fresh"], seen["spare"]) if fall_back else seen["fresh"]
            open_ = (F.get(s["offers"], row["offer"]) == 0) & (~is_fresh | (F.get(s["families"], row["family"]) < family_cap))
            ends = row.isNull() | (F.get(s["filled"], turn["group"]) >= turn["seats"])
            return F.struct(ends.alias("ends"), (~ends & open_).alias("takes"), is_fresh.alias("is_fresh"), turn["pool"].alias("pool"), turn["group"].alias("group"), row["i"].alias("i"), row["family"].alias("family"), row["offer"].alias("offer"))

        def turned(turn: Column) -> Column:
            here = F.get(s["pools"], turn["pool"])
            seen = F.struct(F.get(here, F.get(s["fresh"], turn["pool"])).alias("fresh"), F.get(here, F.get(s["spare"], turn["pool"])).alias("spare"))
            return _let(seen, lambda found: judge(turn, found))

        return _let(F.get(s["queue"], s["turn"]), turned)

    def step(s: Column, _: Column) -> Column:
        # Worked out anew for each counter, which is cheap; a value kept by a lambda would be copied with all it holds.
        saw = look(s)
        takes, moves = F.coalesce(saw["takes"], F.lit(False)), ~saw["ends"]
        return F.when(F.get(s["queue"], s["turn"]).isNull(), s).otherwise(F.struct(
            s["pools"].alias("pools"), s["queue"].alias("queue"), (s["turn"] + (saw["ends"] | takes).cast("int")).alias("turn"),
            _bump(s["fresh"], saw["pool"], moves & saw["is_fresh"]).alias("fresh"), _bump(s["spare"], saw["pool"], moves & ~saw["is_fresh"]).alias("spare"),
            _bump(s["families"], saw["family"], takes).alias("families"), _bump(s["offers"], saw["offer"], takes).alias("offers"), _bump(s["filled"], saw["group"], takes).alias("filled"),
            F.when(takes, F.array_append(s["chosen"], saw["i"])).otherwise(s["chosen"]).alias("chosen"),
        ))

    # A step moves a reading place or ends a turn.
    steps = F.sequence(F.lit(1), (2 * F.col("n")).cast("int") + BANDS * sum(seats))
    chosen = one.select(F.posexplode(F.aggregate(steps, start, step, lambda s: s["chosen"])).alias("_k", "_i"))
    return _ranked(numbered, chosen, "_k").drop("_family", "_offer", "_pool")


def round_robin_bands(leads: DataFrame, score: str, limit: int, family_cap: int = 2) -> DataFrame:
    """Equal turns over the price bands; a family fills at most ``family_cap`` places."""
    _checked(limit)
    order = [F.col(score).desc(), F.col("comparable_count").desc(), F.col("source"), F.col("source_id")]
    kept = _ranks(leads, {"_f": (["price_band", *FAMILY], order)}).filter(F.col("_f") <= family_cap)
    # Within a band, at most `limit` rows are chosen and `limit` belong to families that other bands filled.
    kept = _ranks(kept, {"_r": (["price_band"], order)}).filter(F.col("_r") <= 2 * limit).drop("_f", "_r")
    return _take_turns(kept, order, F.col("price_band"), [limit], family_cap, fall_back=False)


def mix_targets(spark: SparkSession, limit: int) -> DataFrame:
    """Places per damage category: its place in the mix, category and seats."""
    mix = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate(DAMAGE_MIX.items())], "place int, category string, percent int")
    return apportion(mix, "percent", limit, ["place"]).select("place", "category", F.col("seats").cast("int").alias("seats"))


TARGET_IDENTITY = ("make", "model", "year", "mileage_km", "price_eur", "version_text", "city")


def damage_mix_selection(leads: DataFrame, limit: int = 20) -> DataFrame:
    """Places per damage category, turns over bands, preferring families chosen fewer than twice; equal offers once."""
    _checked(limit)
    order = [F.col("priority_score").desc(), F.col("comparable_count").desc(), F.col("source"), F.col("source_id")]
    pools = ["damage_category", "price_band"]
    one = _ranks(leads, {"_t": ([*pools, *TARGET_IDENTITY], order)}).filter("_t = 1").drop("_t")
    ranked = _ranks(one, {"_f": ([*pools, *FAMILY], order), "_r": (pools, order)})
    cut = _ranks(ranked.filter(F.col("_f") <= 2), {"_c": (pools, order)}).filter(F.col("_c") <= 2 * limit).drop("_c")
    kept = cut.unionByName(ranked.filter((F.col("_f") > 2) & (F.col("_r") <= 2 * limit))).drop("_f", "_r")
    seats = mix_targets(leads.sparkSession, limit).orderBy("place").collect()  # a row per category of the mix
    place = F.create_map(*(F.lit(x) for s in seats for x in (s["category"], s["place"])))
    pool = F.lit(BANDS) * F.get(F.array(F.element_at(place, F.col("damage_category"))), F.lit(0)) + F.col("price_band")
    return _take_turns(kept, order, pool, [s["seats"] for s in seats], 2, fall_back=True, offer=F.struct(*TARGET_IDENTITY))


def _soft_cap(limit: int) -> int:
    return max(1, math.ceil(limit * 0.1))


def _quota(limit: int, band: int) -> int:
    return limit // BANDS + (band < limit % BANDS)


def _family_names() -> list[Column]:
    return [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in FAMILY]


#: Who may be chosen, pass after pass: only price priorities, only bands below their share, only families below the cap.
PASSES = ((True, False, False), (False, True, True), (False, True, False), (False, False, True), (False, False, False))


def evidence_balanced_select(leads: DataFrame, limit: int) -> DataFrame:
    """All price priorities first, then equal shares of the bands with a soft family cap, then the rest.

    Needs price_priority_passed, score, comparable_count and price_band.
    """
    cap = _soft_cap(_checked(limit))
    order = [F.col("price_priority_passed").desc(), F.col("score").desc(), F.col("comparable_count").desc(), F.col("source"), F.col("source_id")]
    leads = leads.withColumn("_family", F.struct(*_family_names()))
    near_top = _ranks(leads, {"_bf": (["price_band", "_family"], order)}).filter(F.col("_bf") <= max(cap, limit))
    uncapped = _ranks(near_top, {"_b": (["price_band"], order)}).filter(F.col("_b") <= limit).drop("_b")
    capped = _ranks(near_top.filter(F.col("_bf") <= cap), {"_b": (["price_band"], order)}).filter(F.col("_b") <= 2 * limit).drop("_b")
    kept = uncapped.unionByName(capped).dropDuplicates(["source", "source_id"]).drop("_bf")
    marks = {"_f": F.col("_family")}
    numbered = _numbered(kept, order, marks)
    row = F.struct(F.col("_i").alias("i"), F.col("_f").alias("family"), F.col("price_band").alias("band"), F.coalesce("price_priority_passed", F.lit(False)).alias("priority"))
    one = numbered.agg(F.coalesce(F.max("_f"), F.lit(-1)).alias("f"), F.sort_array(F.collect_list(row)).alias("rows"))
    quota = F.array(*(F.lit(_quota(limit, b)) for b in range(BANDS)))
    passes = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("priority", "share", "cap"), rule, strict=True))) for rule in PASSES))
    # Within a pass, a row that isn't open stays so: counters only rise. One look at each row is enough.
    looks = F.flatten(F.transform(passes, lambda p: F.transform("rows", lambda r: F.struct(p.alias("rule"), r.alias("row")))))
    start = F.struct(_zeros(F.lit(BANDS)).alias("bands"), _zeros(F.col("f") + 1).alias("families"), _zeros(F.size("rows")).alias("taken"), F.array().cast("array<int>").alias("chosen"))

    def step(s: Column, look: Column) -> Column:
        rule, r = look["rule"], look["row"]
        open_ = (F.size(s["chosen"]) < limit) & (F.get(s["taken"], r["i"]) == 0) & (~rule["priority"] | r["priority"])
        open_ &= (~rule["share"] | (F.get(s["bands"], r["band"]) < F.get(quota, r["band"]))) & (~rule["cap"] | (F.get(s["families"], r["family"]) < cap))
        took = F.struct(_bump(s["bands"], r["band"]).alias("bands"), _bump(s["families"], r["family"]).alias("families"), _bump(s["taken"], r["i"]).alias("taken"), F.array_append(s["chosen"], r["i"]).alias("chosen"))
        return F.when(open_, took).otherwise(s)

    chosen = one.select(F.explode(F.aggregate(looks, start, step, lambda s: s["chosen"])).alias("_i"))
    return _ranked(numbered, chosen, "_i").drop("_family", "_f")


def selection_summary(leads: DataFrame, selected: DataFrame, limit: int) -> DataFrame:
    """Per price band: available, target, selected, shortage before places went to other bands, and places gained.

    ``family_cap_relaxed`` tells, on every row, whether a family has more places than the soft cap.
    """
    spark = leads.sparkSession
    quota = [(b, _quota(limit, b)) for b in range(BANDS)]
    families = selected.groupBy(*(c.alias(n) for n, c in zip(FAMILY, _family_names()))).agg(F.count(F.lit(1)).alias("_n"))
    relaxed = families.agg(F.coalesce(F.max("_n") > _soft_cap(limit), F.lit(False)).alias("family_cap_relaxed"))
    bands = spark.createDataFrame(quota, "price_band int, target int")
    have = leads.groupBy("price_band").agg(F.count(F.lit(1)).alias("available"))
    got = selected.groupBy("price_band").agg(F.count(F.lit(1)).alias("selected"))
    return (
        bands.join(have, "price_band", "left").join(got, "price_band", "left").fillna(0, ["available", "selected"])
        .withColumn("shortage", F.greatest(F.lit(0), F.col("target") - F.col("selected")))
        .withColumn("redistributed", F.greatest(F.lit(0), F.col("selected") - F.col("target")))
        .withColumn("_one", F.lit(1)).join(F.broadcast(relaxed.withColumn("_one", F.lit(1))), "_one").drop("_one")
    )


def apportion(shares: DataFrame, share: str, seats: int, ties: Sequence[str]) -> DataFrame:
    """Largest-remainder split of ``seats`` in proportion to whole-number ``share``."""
    # One row per category of a policy: the share table is small by definition.
    everything = Window.partitionBy(F.lit(1))
    raw = F.col(share) * seats
    base = shares.withColumn("_total", F.sum(share).over(everything))
    base = base.withColumn("_floor", F.floor(raw / F.col("_total")).cast("bigint"))
    base = base.withColumn("_rest", raw - F.col("_floor") * F.col("_total"))
    base = base.withColumn("_left", F.lit(seats) - F.sum("_floor").over(everything))
    turn = F.row_number().over(everything.orderBy(F.col("_rest").desc(), *ties))
    return (
        base.withColumn("_r", turn)
        .withColumn("seats", F.col("_floor") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0))
        .drop("_total", "_floor", "_rest", "_r", "_left")
    )
