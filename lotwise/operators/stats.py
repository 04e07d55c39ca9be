"""Weighted and robust price statistics over peers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import age_days, peer_weight_nano, required_margin, stressed_exit
from ..functions.text import labels
from ..session import cut_lineage
from .nearby import envelope_needs, median_needs, near_statistics, share_needs
from .ordered import middle, order_statistics


def price_ladder(pairs: DataFrame, group: Sequence[str], price: str, weight: Column) -> DataFrame:
    """One row per (group, price) with its weight and the running weight up to it.

    Whole-number weights are summed before the shuffle, so a group holds at most one row per
    distinct price however many observations it has.
    """
    rungs = pairs.groupBy(*group, price).agg(
        F.sum(weight).alias("w"), F.sum(weight.cast("decimal(19,0)") * weight.cast("decimal(19,0)")).alias("w2"),
        F.count(F.lit(1)).alias("n"),
    )
    up_to = Window.partitionBy(*group).orderBy(price).rowsBetween(Window.unboundedPreceding, 0)
    return rungs.withColumn("cum_w", F.sum("w").over(up_to))


def weighted_quantiles(
    pairs: DataFrame, group: Sequence[str], price: str, weight: Column, quantiles: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Smallest price whose running weight reaches each share of the total, the count and the
    effective sample size (sum of weights squared over the sum of squared weights)."""
    ladder = price_ladder(pairs, group, price, weight)
    whole = Window.partitionBy(*group)
    ladder = ladder.withColumn("tot_w", F.sum("w").over(whole))
    out = []
    for q in quantiles:
        reached = F.col("cum_w").cast("double") >= F.col("tot_w").cast("double") * F.lit(float(q))
        out.append(F.min(F.when(reached, F.col(price))).alias(f"p{round(q * 100)}"))
    total = F.sum("w").cast("double")
    return ladder.groupBy(*group).agg(
        F.sum("n").alias("comparable_count"),
        *out,
        (total * total / F.sum("w2").cast("double")).alias("effective_sample_size"),
    )


def benchmark_weight(as_of: Column) -> Column:
    """Weight of a pair (target columns plain, peer columns prefixed ``p_``)."""
    return peer_weight_nano(
        F.abs(F.col("year") - F.col("p_year")), F.abs(F.col("mileage_km") - F.col("p_mileage_km")), age_days(as_of, "p_observed_at")
    )


def one_row_per_vehicle(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Keep the newest peer per verified vehicle id and target; peers without an id all stay."""
    with_id = pairs.filter(F.col("p_vehicle_id").isNotNull())
    w = Window.partitionBy(*group, "p_vehicle_id").orderBy(F.col("p_observed_at").desc(), "p_source", "p_source_id")
    first = with_id.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return pairs.filter(F.col("p_vehicle_id").isNull()).unionByName(first)


def asking_benchmark(
    targets: DataFrame, pairs: DataFrame, as_of: Column, *, group: Sequence[str] = ("source", "source_id"),
    minimum: int = 8, max_dispersion: float = 0.3, window_days: int = 30,
) -> DataFrame:
    """Explainable asking-price benchmark of every target from its peer pairs.

    Status is ``benchmark_available`` only for an active, fresh target with enough peers, enough
    effective sample and limited dispersion. The blocking reason is stated otherwise.
    """
    if minimum < 8:
        raise ValueError("a benchmark needs at least 8 peers")
    stats = weighted_quantiles(pairs, group, "p_price_eur", benchmark_weight(as_of))
    return with_benchmark_status(targets.join(stats, list(group), "left"), as_of, minimum=minimum, max_dispersion=max_dispersion, window_days=window_days)


def near_benchmark(
    targets: DataFrame, pool: DataFrame, as_of: Column, *, keys: Sequence[str], in_pool: Column, group: Sequence[str] = ("source", "source_id"),
    own: Column | None = None, minimum: int = 8, max_dispersion: float = 0.3, window_days: int = 30, years: int = 1, km: int = 20_000, tolerant: Sequence[str] = (),
) -> DataFrame:
    """``asking_benchmark`` over the peers within the band, with their sum, low and high price, without a row for each pair.

    ``in_pool`` tells which targets are themselves in the pool, at their own place; ``own`` is the
    weight they have there if the target stands elsewhere.
    """
    if minimum < 8:
        raise ValueError("a benchmark needs at least 8 peers")
    here = peer_weight_nano(F.lit(0), F.lit(0), age_days(as_of, "observed_at")) if own is None else own
    quartiles = share_needs((0.25, 0.5, 0.75))
    stats = near_statistics(
        targets, pool, keys=keys, own=F.when(in_pool, here), needs=lambda total: {**quartiles(total), **envelope_needs(total)}, group=group, years=years, km=km, tolerant=tolerant, age=age_days(as_of, "observed_at"),
    )
    total = F.col("sum_weight").cast("double")
    stats = stats.withColumn("effective_sample_size", total * total / F.col("sum_square").cast("double")).drop("sum_weight", "sum_square")
    stats = stats.withColumnsRenamed({"low_eur": "envelope_low_eur", "high_eur": "envelope_high_eur"})
    return with_benchmark_status(targets.join(stats.hint("merge"), list(group), "left"), as_of, minimum=minimum, max_dispersion=max_dispersion, window_days=window_days)


def with_benchmark_status(joined: DataFrame, as_of: Column, *, minimum: int, max_dispersion: float, window_days: int) -> DataFrame:
    """Targets with comparable_count, quartiles and effective_sample_size; states whether they make a benchmark."""
    start = as_of - F.expr(f"interval {int(window_days)} days")
    outside = ~F.col("active") | (F.col("observed_at") < start) | (F.col("observed_at") > as_of)
    count = F.coalesce(F.col("comparable_count"), F.lit(0))
    spread = F.try_divide(F.col("p75") - F.col("p25"), F.col("p50"))
    reason = F.coalesce(
        F.when(outside | (F.col("price_kind") != "total"), F.lit("target_not_usable")),
        F.when(count < minimum, F.lit("too_few_comparables")),
        F.when(F.col("effective_sample_size") < minimum * 0.75, F.lit("insufficient_effective_sample")),
        F.when(spread > max_dispersion, F.lit("too_dispersed")),
    )
    out = joined.withColumn("comparable_count", count.cast("bigint")).withColumn("benchmark_issue", reason).withColumn(
        "benchmark_status", F.when(reason.isNull(), "benchmark_available").otherwise("insufficient_data")
    )
    ready = F.col("benchmark_issue").isNull()
    for name in ("p25", "p50", "p75", "effective_sample_size"):
        out = out.withColumn(name, F.when(ready, F.col(name)))
    return out


def near_envelope(targets: DataFrame, pool: DataFrame, *, keys: Sequence[str], in_pool: Column, group: Sequence[str] = ("source", "source_id"), years: int = 1, km: int = 20_000) -> DataFrame:
    """``family_envelope`` of the peers within the band: exact middle prices by running counts."""
    stats = near_statistics(targets, pool, keys=keys, own=F.when(in_pool, 1), needs=median_needs, group=group, years=years, km=km)
    middle = F.bround((F.col("middle_low") + F.col("middle_high")) / 2, 0).cast("bigint")
    out = targets.select(*group, "price_eur").join(stats, list(group)).select(
        *group, "price_eur", F.col("comparable_count").alias("observation_count"), "low_eur", middle.alias("typical_eur"), "high_eur"
    )
    return out.withColumn("potential_low_eur", F.col("low_eur") - F.col("price_eur")).withColumn("potential_high_eur", F.col("high_eur") - F.col("price_eur"))


def family_envelope(pairs: DataFrame, group: Sequence[str], price: str = "p_price_eur") -> DataFrame:
    """Low, typical and high matching amounts of each target, and the room above its price."""
    return pairs.groupBy(*group, "price_eur").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.min(price).alias("low_eur"),
        F.bround(F.median(price), 0).cast("bigint").alias("typical_eur"),
        F.max(price).alias("high_eur"),
    ).withColumn("potential_low_eur", F.col("low_eur") - F.col("price_eur")).withColumn(
        "potential_high_eur", F.col("high_eur") - F.col("price_eur")
    )


def half_even_mean(total: Column, count: Column) -> Column:
    """Mean of whole numbers rounded half to even, computed on integers."""
    base = F.floor(total / count).cast("bigint")
    rest2 = (total - base * count) * 2
    return base + F.when((rest2 > count) | ((rest2 == count) & (base % 2 != 0)), 1).otherwise(0)


def broad_signal(offers: DataFrame) -> DataFrame:
    """Mean asking price, required discount and the conservative screen of each target cell.

    ``offers`` is the output of ``broad_peer_cells``: one row per distinct nearby offer.
    """
    close = (F.abs(F.col("year") - F.col("p_year")) <= 1) & (F.abs(F.col("mileage_km") - F.col("p_mileage_km")) <= 20_000)
    price = F.col("p_price_eur")
    return with_broad_signal(offers.groupBy("cell", "price_eur").agg(
        F.count(F.lit(1)).alias("comparable_count"),
        F.sum(price).alias("_sum"),
        F.min(price).alias("asking_low_eur"),
        F.count(F.when(close, 1)).alias("close_count"),
        F.min(F.when(close, price)).alias("lowest_close_eur"),
        F.count(F.when(close & F.col("offer.p_fuel").isNull(), 1)).alias("_no_fuel"),
        F.count(F.when(close & F.col("offer.p_transmission").isNull(), 1)).alias("_no_gear"),
    ))


def with_broad_signal(facts: DataFrame) -> DataFrame:
    """Signal of the cells with two peers or more, from their counts and sums (``broad.broad_facts``)."""
    typical = half_even_mean(F.col("_sum"), F.col("comparable_count"))
    required = required_margin("price_eur")
    return (
        facts.filter(F.col("comparable_count") >= 2)
        .withColumn("asking_typical_eur", typical)
        .withColumn("gross_headroom_eur", F.col("asking_typical_eur") - F.col("price_eur"))
        .withColumn("required_discount_eur", required)
        .withColumn("apparent_opportunity", F.col("gross_headroom_eur") >= F.col("required_discount_eur"))
        .drop("_sum")
    )


def conservative_screen(
    price: Column, lowest: Column, close_count: Column, *, fuel_known: Column, gearbox_known: Column,
    conflicts: Column, clean: Column,
) -> dict[str, Column]:
    """Pessimistic price priority from the lowest close comparable; blockers name what is missing."""
    exit_price = stressed_exit(lowest)
    discount = lowest - price
    remaining = exit_price - price - 750
    required = required_margin(price)
    blockers = labels(
        fewer_than_three_close_price_comparables=close_count < 3,
        identity_conflicts_to_resolve=conflicts,
        fuel_comparison_incomplete=~fuel_known,
        transmission_comparison_incomplete=~gearbox_known,
        purchase_not_at_least_20_percent_below_low_reference=discount * 10_000 < lowest * 2000,
        insufficient_headroom_after_low_exit_and_reserve=remaining < required,
        repaired_condition_resale_and_costs_require_review=~clean,
    )
    return dict(
        lowest_comparable_asking_eur=lowest,
        conservative_exit_scenario_eur=F.when(clean, exit_price),
        asking_discount_eur=discount,
        headroom_after_sale_stress_and_reserve_eur=remaining,
        minimum_required_net_margin_eur=required,
        blocking_reasons=blockers,
        price_priority_passed=F.size(blockers) == 0,
    )


def with_robust_fit(points: DataFrame, group: Sequence[str], train: Column, rounds: int = 4) -> DataFrame:
    """Huber-weighted regression of ``price`` on ``dy`` and ``dkm`` within each group.

    Adds b0, b1, b2 to every row: NULL when the training rows lack independent variation, the
    system is singular or a slope contradicts the market. Each round is nine weighted sums, a
    closed-form solution and two medians, all windows over one partitioning: the points are
    shuffled once and never gathered outside a spillable window.
    """
    whole = Window.partitionBy(*group)
    d = points.withColumn("_t", train).withColumn("_n", F.count(F.when(F.col("_t"), 1)).over(whole))
    for name in ("dy", "dkm"):
        same = Window.partitionBy(*group, name).orderBy(F.col("_t").desc())
        d = d.withColumn("_new", F.when(F.col("_t") & (F.row_number().over(same) == 1), 1))
        d = d.withColumn(f"_n_{name}", F.count("_new").over(whole)).drop("_new")
    only = lambda c: F.when(F.col("_t"), c)
    span = F.max(only(F.col("dkm"))).over(whole) - F.min(only(F.col("dkm"))).over(whole)
    varied = (F.col("_n") >= 12) & (F.col("_n_dy") >= 3) & (F.col("_n_dkm") >= 5) & (F.col("_span") >= 5.0)
    d = d.withColumn("_span", span).withColumn("_t", F.col("_t") & varied).drop("_n", "_n_dy", "_n_dkm", "_span")
    d = d.withColumn("_w", F.when(F.col("_t"), F.lit(1.0)).otherwise(F.lit(0.0))).withColumn("_stop", F.lit(False))
    x, z, y, w = F.col("dy"), F.col("dkm"), F.col("price"), F.col("_w")
    moments = dict(
        w=w, x=w * x, z=w * z, y=w * y, xx=w * x * x, zz=w * z * z, xz=w * x * z, xy=w * x * y, zy=w * z * y
    )
    for step in range(rounds):
        d = d.withColumns({f"_s{k}": F.sum(v).over(whole) for k, v in moments.items()})
        s = {k: F.col(f"_s{k}") for k in moments}
        # Centred second moments reduce the system to two unknowns.
        centred = lambda pair, a, b: s[pair] - F.try_divide(s[a] * s[b], s["w"])
        mxx, mzz, mxz = centred("xx", "x", "x"), centred("zz", "z", "z"), centred("xz", "x", "z")
        mxy, mzy = centred("xy", "x", "y"), centred("zy", "z", "y")
        det = mxx * mzz - mxz * mxz
        solvable = (s["w"] > 0) & (mxx > 1e-8) & (det > 1e-8 * mxx)
        d = d.withColumn("b1", F.when(solvable, F.try_divide(mxy * mzz - mzy * mxz, det)))
        d = d.withColumn("b2", F.when(solvable, F.try_divide(mzy * mxx - mxy * mxz, det)))
        d = d.withColumn("b0", F.try_divide(s["y"] - F.col("b1") * s["x"] - F.col("b2") * s["z"], s["w"]))
        d = d.drop(*[f"_s{k}" for k in moments])
        if step == rounds - 1:
            break
        d = d.withColumn("_r", y - F.col("b0") - F.col("b1") * x - F.col("b2") * z)
        d = d.withColumn("_off", F.abs(F.col("_r") - F.median(only(F.col("_r"))).over(whole)))
        d = d.withColumn("_dev", F.median(only(F.col("_off"))).over(whole) * 1.4826)
        huber = F.least(F.lit(1.0), 1.5 * F.col("_dev") / F.greatest(F.col("_off"), F.lit(1e-8)))
        # A perfect fit keeps its weights, so later rounds return the same coefficients.
        d = d.withColumn("_stop", F.col("_stop") | F.coalesce(F.col("_dev") < 1e-8, F.lit(True)))
        d = d.withColumn("_w", F.when(F.col("_stop") | ~F.col("_t"), F.col("_w")).otherwise(huber)).drop("_r", "_off", "_dev")
    sound = (F.col("b0") > 0) & (F.col("b1") >= -1e-6) & (F.col("b2") <= 1e-6)
    return d.withColumns({b: F.when(sound, F.col(b)) for b in ("b0", "b1", "b2")}).drop("_t", "_w", "_stop")


def price_context(pairs: DataFrame, near: Column, *, group: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """Holdout-validated low, typical and high asking price of every target with a near peer.

    ``pairs`` holds each target with every peer of its variant (``p_`` columns); ``near`` tells the
    close ones. Identical reposts count once. A fit on four fifths of the peers adjusts prices
    only when its error on the rest stays within 20 % and the target lies inside the cohort.
    """
    g = list(group)
    whole = Window.partitionBy(*g)
    repost = Window.partitionBy(*g, "p_year", "p_mileage_km", "p_price_eur", "p_city", "p_version").orderBy("p_source", "p_source_id")
    d = pairs.repartition(*g).withColumn("_first", F.row_number().over(repost)).filter("_first = 1").drop("_first")
    d = d.withColumns({
        "cohort_count": F.count(F.lit(1)).over(whole),
        "_y0": F.min("p_year").over(whole), "_y1": F.max("p_year").over(whole),
        "_k0": F.min("p_mileage_km").over(whole), "_k1": F.max("p_mileage_km").over(whole),
    })
    inside = (
        (F.col("cohort_count") >= 20)
        & F.col("year").between(F.col("_y0"), F.col("_y1")) & F.col("mileage_km").between(F.col("_k0"), F.col("_k1"))
    )
    key = F.sha2(F.concat(F.lit("('"), "p_source", F.lit("', '"), "p_source_id", F.lit("')")), 256)
    turn = F.row_number().over(Window.partitionBy(*g).orderBy(key))
    d = d.withColumn("_inside", inside).withColumn("_held", F.col("_inside") & ((turn - 1) % 5 == 0))
    d = d.withColumn("dy", (F.col("p_year") - F.col("year")).cast("double"))
    d = d.withColumn("dkm", (F.col("p_mileage_km") - F.col("mileage_km")) / F.lit(10000.0))
    d = d.withColumn("price", F.col("p_price_eur").cast("double"))
    d = with_robust_fit(d, g, F.col("_inside") & ~F.col("_held"))
    fitted = F.col("b0") + F.col("b1") * F.col("dy") + F.col("b2") * F.col("dkm")
    held = lambda c: F.when(F.col("_held"), c)
    d = d.withColumn("_mae", F.median(held(F.abs(F.col("price") - fitted))).over(whole))
    d = d.withColumn("relative_error", F.try_divide(F.col("_mae"), F.median(held(F.col("price"))).over(whole)))
    d = d.withColumn("adopted", F.coalesce(F.col("relative_error") <= 0.20, F.lit(False)))
    shift = F.when(F.col("adopted"), F.col("b1") * F.col("dy") + F.col("b2") * F.col("dkm")).otherwise(0.0)
    d = d.filter(near).withColumn("_adj", F.greatest(F.lit(1), F.bround(F.col("price") - shift, 0).cast("bigint")))
    by_price = Window.partitionBy(*g).orderBy("_adj")
    d = d.withColumn("_i", F.row_number().over(by_price)).withColumn("_near", F.count(F.lit(1)).over(whole))
    # The upper quartile is the value at rank floor((n - 1) * 0.75), not a discrete percentile.
    upper = F.max(F.when(F.col("_i") == F.floor((F.col("_near") - 1) * 0.75) + 1, F.col("_adj")))
    facts = ("cohort_count", "relative_error", "adopted", "b1", "b2", "_mae")
    out = d.groupBy(*g).agg(
        *[F.first(f).alias(f) for f in facts],
        F.count(F.lit(1)).alias("context_count"),
        F.least(F.min("_adj"), F.min("p_price_eur")).alias("asking_low_eur"),
        F.bround(F.median("_adj"), 0).cast("bigint").alias("asking_typical_eur"),
        upper.alias("asking_high_eur"),
    )
    return context_judgement(out)


def context_judgement(out: DataFrame) -> DataFrame:
    """Method, confidence and rounded figures of contexts from their fit."""
    confidence = (
        F.when(~F.col("adopted"), "low")
        .when((F.col("context_count") < 8) | (F.col("relative_error") > 0.10) | (F.col("cohort_count") < 40), "medium")
        .otherwise("high")
    )
    return (
        out.withColumn("confidence", confidence)
        .withColumn("method", F.when(F.col("adopted"), "archive_trained_year_mileage").otherwise("unadjusted_comparables"))
        .withColumn("validation_error_eur", F.bround("_mae", 0).cast("bigint"))
        .withColumn("euro_per_newer_year", F.when(F.col("adopted"), F.bround("b1", 2)))
        .withColumn("euro_per_extra_10000_km", F.when(F.col("adopted"), F.bround("b2", 2)))
        .drop("_mae", "b1", "b2")
    )


def learning_summary(contexts: DataFrame) -> DataFrame:
    """How many price contexts were adjusted and validated, and their median holdout error."""
    # Read for the counts and for the ranks.
    one = cut_lineage(contexts.select("method", F.col("validation_error_eur").alias("error")), "contexts")
    counts = one.agg(
        F.count(F.lit(1)).alias("evaluated_targets"),
        F.count(F.when(F.col("method") == "archive_trained_year_mileage", 1)).alias("adjusted_contexts"),
        F.count("error").alias("validated_contexts"),
    )
    ranks = order_statistics(one, [], "error", middle(F.col("n")))
    median = ranks.select(F.bround((F.col("middle_low") + F.col("middle_high")) / 2, 0).cast("bigint").alias("median_holdout_error_eur"))
    return counts.join(F.broadcast(median), F.lit(True), "left")
