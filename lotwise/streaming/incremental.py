"""Change-driven rescoring: only listings whose own facts or comparable basis changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import signature
from ..operators.peers import band_join, cell_key
from ..operators.temporal import KEY, pick_first

STABLE = (
    "url", "active", "make", "model", "generation", "trim", "fuel", "transmission", "province", "seller_type", "condition",
    "year", "mileage_km", "price_eur", "price_kind", "city",
)


def with_signature(listings: DataFrame) -> DataFrame:
    """Hash of a listing without its observation time: a mere refresh changes nothing."""
    return listings.withColumn("signature", signature(*[c for c in STABLE if c in listings.columns]))


def basis_signatures(targets: DataFrame, pairs: DataFrame, peer_fields: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Order-free fingerprint of every target's comparable basis.

    Count, sum and xor of 64-bit peer hashes: computed with partial aggregation, no peer list is
    ever gathered.
    """
    h = F.xxhash64(cell_key(["p_" + f for f in peer_fields]))
    basis = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(h.cast("decimal(20,0)")).alias("_s"), F.bit_xor(h).alias("_x")
    )
    return _signed(targets.join(basis, list(keys), "left"))


def _signed(joined: DataFrame) -> DataFrame:
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("_n", "_s", "_x")])
    return joined.withColumn("basis_signature", F.sha2(text, 256)).withColumn("basis_count", F.coalesce("_n", F.lit(0))).drop("_n", "_s", "_x")


def near_basis_signatures(
    targets: DataFrame, pool: DataFrame, peer_fields: Sequence[str], *, match: Sequence[str], in_pool: Column, years: int = 1, km: int = 20_000,
) -> DataFrame:
    """``basis_signatures`` of the strict comparables within the band, without a row for each pair.

    Count, sum and xor of a position's peers come from cells of (match, year, mileage); a target that is
    itself in the pool (``in_pool``) is taken out of all three again.
    """
    place = [*match, "year", "mileage_km"]
    h = F.xxhash64(cell_key(peer_fields))
    cells = pool.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("x"))
    met = band_join(targets.select(*place).distinct(), cells, list(match), {"year": years, "mileage_km": km})
    basis = met.groupBy(*place).agg(F.sum("p_n").alias("_n"), F.sum("p_s").alias("_s"), F.bit_xor("p_x").alias("_x"))
    own = F.when(F.col("_n").isNotNull() & F.coalesce(in_pool, F.lit(False)), h)
    left = F.col("_n") - F.when(own.isNotNull(), 1).otherwise(0)
    one = targets.join(basis.hint("merge"), place, "left").withColumns({
        "_n": F.when(left > 0, left), "_s": F.when(left > 0, F.col("_s") - F.coalesce(own.cast("decimal(20,0)"), F.lit(0))), "_x": F.when(left > 0, F.col("_x").bitwiseXOR(F.coalesce(own, F.lit(0)))),
    })
    return _signed(one).select(*targets.columns, "basis_signature", "basis_count")


def latest_reviews(reviews: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Newest review per listing; the higher id wins at equal time."""
    return pick_first(reviews, keys, [F.col("as_of").desc(), F.col("id").desc()])


def rescoring_plan(current: DataFrame, reviews: DataFrame, mode: str = "incremental", keys: Sequence[str] = KEY) -> DataFrame:
    """What to do with every current listing: new, changed listing, changed basis or unchanged."""
    if mode not in ("initial", "incremental", "full"):
        raise ValueError("mode must be initial, incremental or full")
    old = latest_reviews(reviews, keys).select(*keys, F.col("signature").alias("_sig"), F.col("basis_signature").alias("_basis"))
    d = current.join(old, list(keys), "left")
    change = (
        F.when(F.col("_sig").isNull(), "new").when(F.col("_sig") != F.col("signature"), "listing_changed")
        .when(F.col("_basis") != F.col("basis_signature"), "basis_changed").otherwise("unchanged")
    )
    d = d.withColumn("change", change).drop("_sig", "_basis")
    return d.withColumn("rescore", F.lit(True) if mode != "incremental" else F.col("change") != "unchanged")


def visible_candidates(reviews: DataFrame, current: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Selected reviews that still hold: same snapshot, same listing and basis, still selected.

    ``current`` is the present screening with signature, basis_signature and selected.
    """
    last = latest_reviews(reviews, keys).filter("selected")
    now = current.filter("selected").select(*keys, "observed_at", "signature", "basis_signature")
    return last.join(now, [*keys, "observed_at", "signature", "basis_signature"], "left_semi")
