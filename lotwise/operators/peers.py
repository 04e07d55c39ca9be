"""Comparable joins: equality on a cohort, closeness on year and mileage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BENCHMARK_MATCH, COHORT, VARIANT_MATCH


def band_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], bands: Mapping[str, int],
    residual: Column | None = None, how: str = "inner",
) -> DataFrame:
    """Pairs with equal ``keys`` and every ``bands`` column within its distance.

    Both sides are cut into cells one band wide and the left rows visit their neighbouring cells,
    so the join is an equi-join on (keys, cells): a popular cohort spreads over its cells
    instead of landing in one task. Right columns come back prefixed ``p_``. Neither side is broadcast:
    estimates know nothing of the visits, nor of what compressed files hold.
    """
    l, r = left, right.select(*[F.col(c).alias("p_" + c) for c in right.columns])
    on = [F.col(k) == F.col("p_" + k) for k in keys]
    for name, width in bands.items():
        cell = F.floor(F.col(name) / width)
        l = l.withColumn(f"_c_{name}", F.explode(F.sequence(cell - 1, cell + 1)))
        r = r.withColumn(f"_d_{name}", F.floor(F.col("p_" + name) / width))
        on += [F.col(f"_c_{name}") == F.col(f"_d_{name}"), F.abs(F.col(name) - F.col("p_" + name)) <= width]
    if residual is not None:
        on.append(residual)
    scratch = [f"_{side}_{name}" for name in bands for side in "cd"]
    return l.join(r.hint("merge"), on, how).drop(*scratch)


def null_tolerant(name: str) -> Column:
    """Unknown on either side is compatible."""
    a, b = F.col(name), F.col("p_" + name)
    return a.isNull() | b.isNull() | (a == b)


def within(name: str, distance: Column | int) -> Column:
    """Unknown on either side is compatible, known values must be near."""
    a, b = F.col(name), F.col("p_" + name)
    return a.isNull() | b.isNull() | (F.abs(a - b) <= distance)


def power_tolerance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(3.0), F.least(a, b) * F.lit(0.1))


def not_self() -> Column:
    return (F.col("source") != F.col("p_source")) | (F.col("source_id") != F.col("p_source_id"))


def all_equal_or_null(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & null_tolerant(n)
    return out


def strict_comparables(
    targets: DataFrame, pool: DataFrame, *, keys: Sequence[str] = ("source",) + COHORT, years: int = 1, km: int = 20_000,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Same-source cohort peers; unknown cohort fields never match. ``pool`` holds the latest,
    active, fresh, total-price listings."""
    residual = not_self()
    if extra:
        residual = residual & all_equal_or_null(extra)
    return band_join(targets, pool, keys, {"year": years, "mileage_km": km}, residual)


def benchmark_pairs(
    targets: DataFrame, pool: DataFrame, *, scope: str = "province", match: Sequence[str] | None = None,
    tolerant: Sequence[str] = (),
) -> DataFrame:
    """Peers of an asking benchmark across sources, by province or nationally."""
    if match is None:
        match = BENCHMARK_MATCH if scope == "province" else VARIANT_MATCH + ("seller_type",)
    elif scope != "province":
        match = [m for m in match if m != "province"]
    residual = not_self()
    if "vehicle_id" in targets.columns and "vehicle_id" in pool.columns:
        residual = residual & ~F.coalesce(F.col("vehicle_id") == F.col("p_vehicle_id"), F.lit(False))
    residual = residual & all_equal_or_null(tolerant)
    return band_join(targets, pool, list(match), {"year": 1, "mileage_km": 20_000}, residual)


BROAD_TEXT = ("fuel", "transmission", "generation", "body_type")


def broad_compatible() -> Column:
    """Discovery compatibility: unknown fits anything, known must agree or be near."""
    return (
        all_equal_or_null(BROAD_TEXT)
        & within("displacement_cc", 50)
        & within("power_hp", power_tolerance(F.col("power_hp"), F.col("p_power_hp")))
    )


BROAD_CELL = (
    "make", "model", "damage_group", "year", "mileage_km", "price_eur", "city", "fuel", "transmission",
    "generation", "body_type", "displacement_cc", "power_hp",
)


def advert_cells(rows: DataFrame, attributes: Sequence[str] = BROAD_CELL, carry: Sequence[str] = ()) -> DataFrame:
    """Collapse adverts that agree on every attribute into one cell with their count.

    Copies, reposts and popular identical offers vanish here, combined before the shuffle, so
    the comparable join works on distinct offers. ``first`` is the earliest listing by key.
    """
    lead = F.struct(*[F.col(c) for c in ("source", "source_id", "observed_at", *carry)])
    return rows.groupBy(*attributes).agg(F.count(F.lit(1)).alias("copies"), F.min(lead).alias("first"))


def cell_key(columns: Sequence[str]) -> Column:
    """128-bit key of the values in their columns; NULL is a value of its own, so values can't change columns."""
    parts = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat(*parts))


def broad_peer_cells(cells: DataFrame, targets: DataFrame | None = None, years: int = 3, km: int = 60_000) -> DataFrame:
    """Distinct (year, mileage, price, city) offers near each target cell.

    A target never counts itself, so its own cell counts only when it holds another copy.
    Offers that differ only in compatible details are one offer, represented by the first.
    """
    cells = cells.withColumn("cell", cell_key(BROAD_CELL))
    left = (cells if targets is None else targets.withColumn("cell", cell_key(BROAD_CELL))).drop("first", "copies")
    other = (F.col("cell") != F.col("p_cell")) | (F.col("p_copies") > 1)
    pairs = band_join(
        left, cells, ["make", "model", "damage_group"], {"year": years, "mileage_km": km}, broad_compatible() & other
    )
    offer = F.struct("p_first", "p_fuel", "p_transmission")
    return pairs.groupBy(
        "cell", "price_eur", "year", "mileage_km", "p_year", "p_mileage_km", "p_price_eur", "p_city"
    ).agg(F.min(offer).alias("offer"))


def third_party_compatible() -> Column:
    """Cross-source compatibility: tolerant on specs, one-sided on premium drive and body."""
    t, p = F.col("variant"), F.col("p_variant")
    agree = lambda a, b: a.isNull() | b.isNull() | (a == b)
    return (
        all_equal_or_null(("fuel", "transmission", "generation"))
        & within("displacement_cc", 50)
        & within("power_hp", power_tolerance(F.col("power_hp"), F.col("p_power_hp")))
        & (t["sport"] == p["sport"])
        & agree(t["drive"], p["drive"])
        & agree(t["body"], p["body"])
        & ~(F.coalesce(t["drive"] == "awd", F.lit(False)) & ~F.coalesce(p["drive"] == "awd", F.lit(False)))
        & ~(F.coalesce(t["body"].isin("wagon", "convertible"), F.lit(False)) & ~F.coalesce(p["body"] == t["body"], F.lit(False)))
        & (t["litres"].isNull() | p["litres"].isNull() | (F.abs(t["litres"] - p["litres"]) <= F.lit(0.05)))
    )


def third_party_pairs(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """Family peers of another source; unknown target mileage tries both units of the raw figure.

    Targets carry ``mileage_options``; a peer that matches any hypothesis counts once.
    """
    options = targets.withColumn("mileage_km", F.explode("mileage_options"))
    pairs = band_join(
        options, pool, ["family_make", "family_model"], {"year": 1, "mileage_km": 20_000},
        third_party_compatible() & not_self(),
    )
    return pairs.dropDuplicates(["source", "source_id", "p_source", "p_source_id"])


def mileage_hypotheses(km: Column, raw_miles: Column) -> Column:
    """The stated kilometres, or both readings of an unlabelled provider figure."""
    plausible = (raw_miles >= 0) & (raw_miles <= 1_000_000)
    both = F.array_sort(F.array_distinct(F.array(raw_miles.cast("bigint"), (raw_miles * F.lit(1.609344)).cast("bigint"))))
    return F.when(km.isNotNull(), F.array(km)).when(plausible, both).otherwise(F.array().cast("array<bigint>"))


SAME_VARIANT_FIELDS = (
    "generation", "trim", "power_hp", "power_kw", "displacement_cc", "engine_code", "engine_name", "drivetrain", "body_type",
)


def same_variant(fields: Sequence[str] = SAME_VARIANT_FIELDS) -> Column:
    """Strict variant agreement on columns ``version`` (normal text), ``signature``, power and cc.

    Known fields must agree; equal headlines suffice; different headlines need equal published
    engine figures and equal signatures; without headlines generation and trim must both agree.
    """
    known_agree = all_equal_or_null(fields)
    a, b = F.col("version"), F.col("p_version")
    engine = F.coalesce((F.col("power_hp") == F.col("p_power_hp")) & (F.col("displacement_cc") == F.col("p_displacement_cc")), F.lit(False))
    s, q = F.col("signature"), F.col("p_signature")
    roman = s["roman"].isNull() | q["roman"].isNull() | (s["roman"] == q["roman"])
    headline = F.coalesce(a == b, F.lit(False)) | (
        a.isNotNull() & b.isNotNull() & engine & roman & F.coalesce(s["label"] == q["label"], F.lit(False))
    )
    bare = F.coalesce((F.col("generation") == F.col("p_generation")) & (F.col("trim") == F.col("p_trim")), F.lit(False))
    return known_agree & F.when(a.isNotNull() | b.isNotNull(), headline).otherwise(bare)


def vehicle_cohort_or_self(keys_of: DataFrame, pool: DataFrame, cohort: Sequence[str] = COHORT) -> DataFrame:
    """Candidates that share a vehicle id, the cohort or the key itself.

    Three equi-joins united, in place of one join on a disjunction.
    """
    p = pool.select(*[F.col(c).alias("p_" + c) for c in pool.columns])
    parts = []
    for columns in (("vehicle_id",), tuple(cohort), ("source", "source_id")):
        on = [F.col(c) == F.col("p_" + c) for c in columns]
        parts.append(keys_of.join(p, on).select("source", "source_id", "p_source", "p_source_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def candidate_counts(keys_of: DataFrame, pool: DataFrame, cohort: Sequence[str] = COHORT) -> DataFrame:
    """Number of ``vehicle_cohort_or_self`` candidates of each key, without a row for each of them.

    A candidate of two or three of the rules counts once: numbers of rows that agree on the columns of one
    rule or of all three are added, those of two rules taken off. Both tables hold a key once. Keys without a
    candidate have no row.
    """
    key, vehicle, cohort = ("source", "source_id"), ("vehicle_id",), tuple(cohort)
    out, terms = keys_of, []
    for n, (sign, rules) in enumerate([(1, (vehicle,)), (1, (cohort,)), (1, (key,)), (-1, (vehicle, cohort)), (-1, (vehicle, key)), (-1, (cohort, key)), (1, (vehicle, cohort, key))]):
        on = list(dict.fromkeys(c for rule in rules for c in rule))
        out = out.join(pool.groupBy(*on).agg(F.count(F.lit(1)).alias(f"_n{n}")).hint("merge"), on, "left")
        terms.append(F.coalesce(F.col(f"_n{n}"), F.lit(0)) * sign)
    return out.withColumn("candidates", sum(terms[1:], terms[0])).filter("candidates > 0").select(*key, "candidates")
