"""Union, repost collapse, checksums, content-addressed assets and offer de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running
from .temporal import pick_first

# What makes two adverts the same offer, per use.
REPOST_KEYS = {
    "research": ("year", "mileage_km", "label", "price_eur", "city"),
    "pricing": ("year", "mileage_km", "price_eur", "city", "version_text"),
    "discovery": ("year", "mileage_km", "price_eur", "city"),
    "third_party": ("year", "mileage_km", "price_eur", "city", "version_text"),
}


def union_distinct(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; rows of ``first`` win over rows of ``second``."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in first.columns if c not in keys]
    return pick_first(both, keys, [F.col("_side"), *rest]).drop("_side")


def collapse_reposts(rows: DataFrame, kind: str, within: Sequence[str] = (), order: Sequence[Column] = ()) -> DataFrame:
    """First advert per indistinguishable offer, in a stated order."""
    order = order or [F.col("source"), F.col("source_id")]
    return pick_first(rows, [*within, *REPOST_KEYS[kind]], order)


def checksum_status(pages: DataFrame, key: Sequence[str], checksum: str) -> DataFrame:
    """Per page id: how often it arrived and whether its content ever differed."""
    return pages.groupBy(*key).agg(
        F.count(F.lit(1)).alias("arrivals"), F.min(checksum).alias("_lo"), F.max(checksum).alias("_hi")
    ).select(
        *key, "arrivals",
        F.when(F.col("_lo") != F.col("_hi"), "conflicting_content").when(F.col("arrivals") > 1, "repeated").otherwise("new").alias("status"),
    )


def content_assets(references: DataFrame, content: str, saved_at: str) -> DataFrame:
    """One asset per distinct content with its first use and reference count.

    Only the hash is shuffled; the bytes stay where they are until a caller joins them back.
    """
    hashed = references.select(
        F.sha2(F.col(content).cast("binary"), 256).alias("sha"), F.octet_length(content).alias("byte_count"), F.col(saved_at).alias("_at")
    )
    return hashed.groupBy("sha").agg(
        F.first("byte_count").alias("byte_count"), F.min("_at").alias("first_saved"), F.count(F.lit(1)).alias("reference_count")
    )


def within_storage_cap(assets: DataFrame, cap_bytes: int) -> DataFrame:
    """Assets saved before the running total of bytes reached the cap, oldest first.

    The running total is a prefix sum over ranges of (time, digest), so no task orders all assets of
    a time, however many were saved at once.
    """
    total = running(assets, [], [F.col("first_saved"), F.col("sha")], "byte_count", "running_bytes")
    return total.withColumn("stored", F.col("running_bytes") <= cap_bytes)


def newest_offer(offers: DataFrame, keys: Sequence[str], observed: str, cost: str, ties: Sequence[str] = ()) -> DataFrame:
    """Newest offer per seller and product, the cheaper one at equal time."""
    return pick_first(offers, keys, [F.col(observed).desc(), F.col(cost).asc(), *[F.col(t).asc() for t in ties]])


def covers(required: Column, available: Column) -> Column:
    """Every element of ``required`` is in ``available``."""
    return F.size(F.array_except(required, available)) == 0


def shared_photos(listings: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """Photos used by more than one listing, with the number of listings and the first of them.

    Linear in the photo references: a popular photo is one row, not all pairs of its users.
    """
    links = listings.select(*keys, F.explode(F.array_distinct("image_urls")).alias("photo")).distinct()
    return links.groupBy("photo").agg(
        F.count(F.lit(1)).alias("listing_count"), F.min(F.struct(*keys)).alias("first_listing")
    ).filter("listing_count > 1")


def repost_signals(listings: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """Per listing: photos it shares with others and the widest use among them."""
    shared = shared_photos(listings, keys).select("photo", "listing_count")
    links = listings.select(*keys, F.explode(F.array_distinct("image_urls")).alias("photo"))
    return links.join(shared, "photo").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shared_photo_count"), F.max("listing_count").alias("widest_use")
    )


def shared_photo_matches(targets: DataFrame, pool: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """Other listings that reuse a photo of the given targets, for a requested set of targets."""
    t = targets.select(*keys, F.explode(F.array_distinct("image_urls")).alias("photo"))
    p = pool.select(*[F.col(k).alias("p_" + k) for k in keys], F.col("url").alias("p_url"), F.explode(F.array_distinct("image_urls")).alias("photo"))
    other = F.lit(False)
    for k in keys:
        other = other | (F.col(k) != F.col("p_" + k))
    return t.join(p, "photo").filter(other).drop("photo").distinct()
