"""Price contexts of whole variants without a row for each pair of listings.

Targets that agree on every field a peer search reads have the same peers but for their own offer, so they
are one case. A variant's cases are dealt to blocks, and a block meets its variant's offers within a task:
what is written grows with offers times blocks, not with pairs. Fits are those of ``stats.price_context``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .peers import band_join, cell_key, same_variant
from .stats import context_judgement
from .temporal import pick_first

#: Cases of a block, and how many (case, offer) figures a step holds at once.
BLOCK_CASES = 1024
STEP_FIGURES = 1 << 18

FACTS = "case string, cohort_count long, relative_error double, adopted boolean, b1 double, b2 double, _mae double, context_count long, asking_low_eur long, asking_typical_eur long, asking_high_eur long"
OWN = ("_own_source", "_own_id")
PLACE = ("year", "mileage_km", "price_eur", "city")


def listing_key(source: str, source_id: str) -> Column:
    """Digest that orders a variant's offers for the holdout."""
    return F.sha2(F.concat(F.lit("('"), F.col(source), F.lit("', '"), F.col(source_id), F.lit("')")), 256)


def _middle(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Median of each row's masked values; NaN where there are none."""
    n = mask.sum(1)
    ordered = np.sort(np.where(mask, values, np.inf), axis=1)
    at = lambda i: np.take_along_axis(ordered, np.clip(i, 0, values.shape[1] - 1)[:, None], 1)[:, 0]
    return np.where(n > 0, 0.5 * at((n - 1) // 2) + 0.5 * at(n // 2), np.nan)


def _at_least(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """Whether each row's masked values hold ``k`` different ones."""
    last = np.full(len(mask), -np.inf)
    for _ in range(k):
        last = np.where(mask & (values > last[:, None]), values, np.inf).min(1)
    return np.isfinite(last)


def _robust_fit(dy: np.ndarray, dkm: np.ndarray, price: np.ndarray, train: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``stats.with_robust_fit`` of each row: b0, b1, b2, NaN where no sound fit exists."""
    span = np.where(train, dkm, -np.inf).max(1) - np.where(train, dkm, np.inf).min(1)
    varied = (train.sum(1) >= 12) & (span >= 5.0) & _at_least(dy, train, 3) & _at_least(dkm, train, 5)
    train = train & varied[:, None]
    w, stop = train.astype("float64"), np.zeros(len(train), bool)
    for step in range(rounds):
        s = {k: np.einsum(e, *a) for k, e, a in (
            ("w", "ij->i", (w,)), ("x", "ij,ij->i", (w, dy)), ("z", "ij,ij->i", (w, dkm)), ("y", "ij,ij->i", (w, price)), ("xx", "ij,ij,ij->i", (w, dy, dy)), ("zz", "ij,ij,ij->i", (w, dkm, dkm)),
            ("xz", "ij,ij,ij->i", (w, dy, dkm)), ("xy", "ij,ij,ij->i", (w, dy, price)), ("zy", "ij,ij,ij->i", (w, dkm, price)),
        )}
        centred = lambda pair, a, b: s[pair] - s[a] * s[b] / s["w"]
        mxx, mzz, mxz = centred("xx", "x", "x"), centred("zz", "z", "z"), centred("xz", "x", "z")
        mxy, mzy = centred("xy", "x", "y"), centred("zy", "z", "y")
        det = mxx * mzz - mxz * mxz
        solvable = (s["w"] > 0) & (mxx > 1e-8) & (det > 1e-8 * mxx)
        b1 = np.where(solvable, (mxy * mzz - mzy * mxz) / det, np.nan)
        b2 = np.where(solvable, (mzy * mxx - mxy * mxz) / det, np.nan)
        b0 = (s["y"] - b1 * s["x"] - b2 * s["z"]) / s["w"]
        if step == rounds - 1:
            break
        fitted = train & solvable[:, None]
        off = price - b0[:, None] - b1[:, None] * dy - b2[:, None] * dkm
        off = np.abs(off - _middle(off, fitted)[:, None])
        dev = _middle(off, fitted) * 1.4826
        # A perfect fit keeps its weights, so later rounds return the same coefficients.
        stop |= ~(dev >= 1e-8)
        w = np.where(train & ~stop[:, None], np.minimum(1.0, 1.5 * dev[:, None] / np.maximum(off, 1e-8)), w)
    sound = (b0 > 0) & (b1 >= -1e-6) & (b2 <= 1e-6)
    return tuple(np.where(sound, b, np.nan) for b in (b0, b1, b2))


def _judged(cases: pd.DataFrame, offers: pd.DataFrame, years: int, km: int) -> pd.DataFrame:
    """Context of each case among the offers, which lie in the holdout's order."""
    year, mileage, price = (offers[c].to_numpy("int64") for c in ("p_year", "p_mileage_km", "p_price_eur"))
    y, k = (cases[c].to_numpy("int64")[:, None] for c in ("year", "mileage_km"))
    key, lead = offers["key"].to_numpy("S64"), offers["lead"].to_numpy("S64")
    own = cases["own"].fillna("").to_numpy("S64")[:, None]
    # An offer stands for its reposts unless it is the case's own; then the next listing does.
    valid = np.where(lead == key, key != own, lead == own)
    count = valid.sum(1)
    least = lambda v: np.where(valid, v, np.iinfo("int64").max).min(1)
    most = lambda v: np.where(valid, v, np.iinfo("int64").min).max(1)
    inside = (count >= 20) & (least(year) <= y[:, 0]) & (y[:, 0] <= most(year)) & (least(mileage) <= k[:, 0]) & (k[:, 0] <= most(mileage))
    held = valid & inside[:, None] & ((np.cumsum(valid, axis=1) - 1) % 5 == 0)
    dy, dkm = (year - y).astype("float64"), (mileage - k) / 10000.0
    prices = np.broadcast_to(price.astype("float64"), valid.shape)
    with np.errstate(all="ignore"):
        b0, b1, b2 = _robust_fit(dy, dkm, prices, valid & inside[:, None] & ~held)
        found = np.isfinite(b0)
        fitted = b0[:, None] + b1[:, None] * dy + b2[:, None] * dkm
        mae = _middle(np.abs(prices - fitted), held & found[:, None])
        middle = _middle(prices, held)
        error = np.where(middle == 0, np.nan, mae / middle)
        adopted = error <= 0.20
        shift = np.where(adopted[:, None], b1[:, None] * dy + b2[:, None] * dkm, 0.0)
        near = valid & (np.abs(dy) <= years) & (np.abs(mileage - k) <= km)
        adjusted = np.where(near, np.maximum(1.0, np.rint(prices - shift)), np.inf)
    n = near.sum(1)
    some = n > 0
    ordered = np.sort(adjusted, axis=1)
    upper = np.take_along_axis(ordered, np.floor(np.maximum(n - 1, 0) * 0.75).astype("int64")[:, None], 1)[:, 0]
    low = np.minimum(ordered[:, 0], np.where(near, prices, np.inf).min(1))
    typical = np.rint(_middle(adjusted, near))
    whole = lambda v: v[some].astype("int64")
    known = lambda v: pd.array(v[some], dtype="Float64")
    return pd.DataFrame({
        "case": cases["case"].to_numpy()[some], "cohort_count": whole(count), "relative_error": known(error), "adopted": adopted[some], "b1": known(b1), "b2": known(b2), "_mae": known(mae),
        "context_count": whole(n), "asking_low_eur": whole(low), "asking_typical_eur": whole(typical), "asking_high_eur": whole(upper),
    })


def _block_of(years: int, km: int):
    def judge(key: tuple, cases: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        if not len(cases) or not len(offers):
            return pd.DataFrame({name.split()[0]: [] for name in FACTS.split(", ")})
        offers = offers.iloc[np.argsort(offers["key"].to_numpy("S64"), kind="stable")]
        step = max(1, STEP_FIGURES // len(offers))
        return pd.concat([_judged(cases.iloc[i : i + step], offers, years, km) for i in range(0, len(cases), step)], ignore_index=True)

    return judge


def _named(targets: DataFrame, offers: DataFrame, match: Sequence[str], attributes: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Targets with their case, the cases, the families of targets with those of the offers they accept, and the offers.

    Families agree on all ``attributes`` but the place; families meet, and listings follow by the family's name.
    """
    family = [c for c in attributes if c not in PLACE]
    flat = lambda df: df.select("source", "source_id", *attributes).withColumn("_family", cell_key(family))
    offers = cut_lineage(flat(offers), "offers")
    mine = offers.select("source", "source_id", F.col("source").alias("_own_source"), F.col("source_id").alias("_own_id")).hint("merge")
    named = flat(targets).join(mine, ["source", "source_id"], "left")
    named = cut_lineage(named.withColumn("case", cell_key([*attributes, *OWN])), "named")
    cases = named.groupBy("case", "_family", "year", "mileage_km", *OWN).agg(F.count(F.lit(1))).withColumn("own", F.when(F.col("_own_id").isNotNull(), listing_key(*OWN)))
    left = named.groupBy("_family", *family).agg(F.count_distinct("case").alias("_cases"))
    right = offers.select("_family", *family).distinct()
    right = right.select(*[F.col(c).alias("p_" + c) for c in right.columns])
    agree = [F.col(c) == F.col("p_" + c) for c in match] + [same_variant()]
    met = left.join(right.hint("merge"), agree).select("_family", F.col("p__family").alias("_other"), F.ceil(F.col("_cases") / BLOCK_CASES).cast("int").alias("_blocks"))
    return named, cases, cut_lineage(met, "families"), offers


def near_counts(targets: DataFrame, offers: DataFrame, *, match: Sequence[str], attributes: Sequence[str], years: int, km: int) -> DataFrame:
    """Number and least price of the distinct offers near each target that has one.

    Version or trim tells offers apart here. Offers are made distinct before they meet the cases, so a pair is
    counted where it arises and no row of it is written.
    """
    named, cases, met, offers = _named(targets, offers, match, attributes)
    listed = offers.select(F.col("_family").alias("_other"), "source", "source_id", *PLACE, F.coalesce("version", "trim").alias("label"))
    offer = ["_family", "year", "mileage_km", "label", "price_eur", "city"]
    two = pick_first(met.select("_family", "_other").join(listed.hint("merge"), "_other"), offer, [F.col("source"), F.col("source_id")], keep=2)
    distinct = two.groupBy(*offer).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("source", "source_id")).alias("lead"))
    alone = (F.col("p_copies") == 1) & F.coalesce((F.col("p_lead.source") == F.col("_own_source")) & (F.col("p_lead.source_id") == F.col("_own_id")), F.lit(False))
    pairs = band_join(cases.select("case", "_family", "year", "mileage_km", *OWN), distinct, ["_family"], {"year": years, "mileage_km": km}, ~alone)
    counts = pairs.groupBy("case").agg(F.count(F.lit(1)).alias("comparable_count"), F.min("p_price_eur").alias("near_low_eur"))
    return named.select("source", "source_id", "price_eur", "case").join(counts.hint("merge"), "case").drop("case")


def variant_contexts(targets: DataFrame, offers: DataFrame, *, match: Sequence[str], attributes: Sequence[str], years: int, km: int) -> DataFrame:
    """``stats.price_context`` of every target among the ``offers`` of its variant that aren't its own listing.

    ``match`` columns must be equal, the rest of a variant is ``peers.same_variant``; ``attributes`` are all
    columns a peer search reads, ``match``, year, mileage_km, price_eur, city and version among them. Offers lie
    near within ``years`` and ``km``.
    """
    named, cases, met, offers = _named(targets, offers, match, attributes)
    listed = offers.select(F.col("_family").alias("_other"), F.col("source").alias("p_source"), F.col("source_id").alias("p_source_id"), listing_key("source", "source_id").alias("key"), *[F.col(c).alias("p_" + c) for c in (*PLACE, "version")])
    repost = ["_family", "p_year", "p_mileage_km", "p_price_eur", "p_city", "p_version"]
    # One listing stands for its reposts, the next one where that is the target's own.
    some = pick_first(met.join(listed.hint("merge"), "_other"), repost, [F.col("p_source"), F.col("p_source_id")], keep=2)
    order = Window.partitionBy(*repost).orderBy("p_source", "p_source_id")
    some = some.withColumn("lead", F.first("key").over(order)).select("_family", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "key", "lead", "p_year", "p_mileage_km", "p_price_eur")

    blocks = met.groupBy("_family").agg(F.first("_blocks").alias("_blocks"))
    dealt = cases.join(blocks.hint("merge"), "_family").select("_family", F.pmod(F.xxhash64("case"), F.col("_blocks").cast("bigint")).cast("int").alias("_block"), "case", "own", "year", "mileage_km")
    facts = dealt.groupBy("_family", "_block").cogroup(some.groupBy("_family", "_block")).applyInPandas(_block_of(years, km), FACTS)
    return context_judgement(named.select("source", "source_id", "case").join(facts.hint("merge"), "case").drop("case"))
