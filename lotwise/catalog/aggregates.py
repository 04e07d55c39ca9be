"""Weighted quantiles, benchmarks, signals, coverage and measured errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import broad, economics, evaluation, nearby, parts, peers, quality, stats
from . import base as b
from .base import query
from .joins import NOT_SELF, POOL, _NARROW, b_pool, benchmark_ctes, near_sql
from .predicates import margin_sql


@query("weighted_quantiles", """with r as (select l_partkey, cast(floor(l_extendedprice) as bigint) price, cast(sum(cast(l_quantity as bigint)) as bigint) w, cast(sum(cast(l_quantity as decimal(19,0)) * cast(l_quantity as decimal(19,0))) as double) w2, count(*) n from lineitem group by 1, 2),
 c as (select *, sum(w) over (partition by l_partkey order by price rows unbounded preceding) cum, sum(w) over (partition by l_partkey) tot from r)
 select l_partkey, cast(sum(n) as bigint) as comparable_count, min(price) filter (cast(cum as double) >= cast(tot as double) * 0.25) as p25, min(price) filter (cast(cum as double) >= cast(tot as double) * 0.5) as p50,
 min(price) filter (cast(cum as double) >= cast(tot as double) * 0.75) as p75, cast(floor(cast(sum(w) as double) * cast(sum(w) as double) / sum(w2) * 1000) as bigint) as ess_milli from c group by l_partkey""")
def weighted_quantiles(spark, d):
    li = b.table(spark, d, "lineitem").withColumn("price", F.floor("l_extendedprice").cast("bigint"))
    out = stats.weighted_quantiles(li, ["l_partkey"], "price", F.col("l_quantity").cast("bigint"))
    return out.withColumn("ess_milli", F.floor(F.col("effective_sample_size") * 1000).cast("bigint")).drop("effective_sample_size")


@query("asking_benchmark", b.with_asks("""select source, source_id, comparable_count, benchmark_issue, case when benchmark_issue is null then p25 end as p25, case when benchmark_issue is null then p50 end as p50,
  case when benchmark_issue is null then p75 end as p75, case when benchmark_issue is null then cast(floor(ess * 100) as bigint) end as ess_centi from bm""",
  benchmark_ctes("bm", f"t.make = p.make and t.seller_type = p.seller_type and {near_sql(1, 20000)} and p.price_kind = 'total'", "2.0")))
def asking_benchmark(spark, d):
    f = b.fresh(spark, d)
    out = stats.near_benchmark(f, f.filter(b_pool()), b.as_of(), keys=("make", "seller_type"), in_pool=b_pool(), max_dispersion=2.0, window_days=b.WINDOW_DAYS)
    return out.select(
        "source", "source_id", "comparable_count", "benchmark_issue", "p25", "p50", "p75", F.floor(F.col("effective_sample_size") * 100).cast("bigint").alias("ess_centi")
    )


@query("family_envelope", b.with_asks(f"""select t.source, t.source_id, count(*) as observation_count, min(p.price_eur) as low_eur, cast(round_even(median(p.price_eur), 0) as bigint) as typical_eur, max(p.price_eur) as high_eur,
  min(p.price_eur) - t.price_eur as potential_low_eur, max(p.price_eur) - t.price_eur as potential_high_eur from fresh t join fresh p on t.make = p.make and t.model = p.model and {near_sql(1, 20000)} and {NOT_SELF} where p.{POOL} group by t.source, t.source_id, t.price_eur"""))
def family_envelope(spark, d):
    f = b.fresh_once(spark, d)
    return stats.near_envelope(f, f.filter(b_pool()), keys=("make", "model"), in_pool=b_pool()).drop("price_eur")


_OFFERS = f"""offers as (select t.source, t.source_id, t.price_eur, t.year ty, t.mileage_km tk, p.year py, p.mileage_km pk, p.price_eur pp, p.city pc, min(struct_pack(s := p.source, i := p.source_id)) as lead from broad t join broad p on t.make = p.make and t.model = p.model and {near_sql(3, 60000)} and {NOT_SELF}
 and (t.fuel is null or p.fuel is null or t.fuel = p.fuel) and (t.transmission is null or p.transmission is null or t.transmission = p.transmission) and (t.generation is null or p.generation is null or t.generation = p.generation)
 and (t.body_type is null or p.body_type is null or t.body_type = p.body_type) and (t.displacement_cc is null or p.displacement_cc is null or abs(t.displacement_cc - p.displacement_cc) <= 50)
 and (t.power_hp is null or p.power_hp is null or abs(t.power_hp - p.power_hp) <= greatest(3.0, least(t.power_hp, p.power_hp) * 0.1)) group by all)"""
_PEER_ORDER = "py, pk // 10000, lead.s, lead.i"
_RANKED = f"""ranked as (select *, count(*) over (partition by source, source_id) as n, row_number() over (partition by source, source_id order by {_PEER_ORDER}) - 1 as r,
 row_number() over (partition by source, source_id order by pp, {_PEER_ORDER}) as cheap, row_number() over (partition by source, source_id order by pp desc, {_PEER_ORDER}) as dear from offers)"""
#: The cheapest, 48 at even steps and the dearest of more than 50 peers, all of fewer.
_TAKEN = """taken as (select *, case when n <= 50 then r when cheap = 1 then -1 when list_contains(list_transform(range(1, 49), lambda i: cast(round_even(i * (n - 1) / 49, 0) as bigint)), r) then r when dear = 1 then n end as seq from ranked)"""


@query("broad_signal", b.with_asks(f"""select source, source_id, count(*) as comparable_count, cast(round_even(sum(pp) / count(*), 0) as bigint) as asking_typical_eur, min(pp) as asking_low_eur,
  cast(round_even(sum(pp) / count(*), 0) as bigint) - price_eur >= {margin_sql('price_eur')} as apparent_opportunity, count(*) filter (abs(ty - py) <= 1 and abs(tk - pk) <= 20000) as close_count,
  count(seq) as evidence_count, string_agg(lead.s || '/' || lead.i, ',' order by case when n > 50 then pp end, seq) filter (seq is not null) as evidence
  from taken group by source, source_id, price_eur having count(*) >= 2""", "broad as (select * from fresh where price_kind = 'total' and price_eur > 0)", _OFFERS, _RANKED, _TAKEN))
def broad_signal(spark, d):
    from .joins import _broad

    rows = _broad(spark, d).filter("price_eur > 0")
    return stats.with_broad_signal(broad.broad_evidence(rows)).select(
        "source", "source_id", "comparable_count", "asking_typical_eur", "asking_low_eur", "apparent_opportunity", "close_count", "evidence_count", "evidence"
    )


@query("conservative_screen", b.with_asks(f"""select source, source_id, low as lowest_comparable_asking_eur, low * 85 // 100 as conservative_exit_scenario_eur, low - price_eur as asking_discount_eur, low * 85 // 100 - price_eur - 750 as headroom,
  n >= 3 and (low - price_eur) * 10000 >= low * 2000 and low * 85 // 100 - price_eur - 750 >= {margin_sql('price_eur')} and fuel is not null and transmission is not null and no_fuel = 0 and no_gear = 0 as price_priority_passed from (
  select t.source, t.source_id, t.price_eur, t.fuel, t.transmission, min(p.price_eur) low, count(*) n, count(*) filter (p.fuel is null) no_fuel, count(*) filter (p.transmission is null) no_gear
  from fresh t join fresh p on t.make = p.make and t.model = p.model and {near_sql(1, 20000)} and {NOT_SELF} where p.{POOL} and t.price_eur > 0 group by 1, 2, 3, 4, 5)"""))
def conservative_screen(spark, d):
    f = b.fresh_once(spark, d)
    near = nearby.near_statistics(
        f.filter("price_eur > 0"), f.filter(b_pool()), keys=("make", "model"), own=F.when(b_pool(), 1), needs=lambda total: {"low": F.lit(1)},
        flags={"nf": F.col("fuel").isNull(), "ng": F.col("transmission").isNull()},
    )
    g = f.select("source", "source_id", "price_eur", "fuel", "transmission").join(near.withColumnRenamed("comparable_count", "n"), ["source", "source_id"])
    cols = stats.conservative_screen(
        F.col("price_eur"), F.col("low"), F.col("n"), fuel_known=F.col("fuel").isNotNull() & (F.col("nf") == 0),
        gearbox_known=F.col("transmission").isNotNull() & (F.col("ng") == 0), conflicts=F.lit(False), clean=F.lit(True),
    )
    return g.withColumns(cols).select(
        "source", "source_id", "lowest_comparable_asking_eur", "conservative_exit_scenario_eur", "asking_discount_eur",
        F.col("headroom_after_sale_stress_and_reserve_eur").alias("headroom"), "price_priority_passed",
    )


_FIELDS = ("generation", "fuel", "version_text", "power_hp", "displacement_cc", "city", "condition")


@query("quality_profile", b.with_asks("select * from (" + " union all ".join(
    f"select '{f}' as field, count(*) filter (coalesce(cast({f} as string), '') <> '') as usable, count(*) filter (coalesce(cast({f} as string), '') = '') as missing from latest" for f in _FIELDS) + ")"))
def quality_profile(spark, d):
    return quality.coverage(b.latest(spark, d), _FIELDS)


@query("field_profile", b.with_asks("select * from (" + " union all ".join(
    f"select '{f}' as field, count(*) filter (coalesce(lower(trim(cast({f} as string))), '') not in ('', 'unknown', 'unclassified', 'n/a', '-', 'sconosciuto')) as usable, count(*) filter (coalesce(lower(trim(cast({f} as string))), '') in ('', 'unknown', 'unclassified', 'n/a', '-', 'sconosciuto')) as missing from fresh" for f in _FIELDS) + ")"))
def field_profile(spark, d):
    return quality.coverage(b.fresh(spark, d), _FIELDS, usable="present")


@query("photo_coverage", """select count(*) as listings, count(*) filter (n > 0) as listings_with_photos, cast(sum(n) as bigint) as photo_links from (select len(regexp_extract_all(html, 'href="([^"]+)"', 1)) n from pages)""")
def photo_coverage(spark, d):
    from .joins import _linked

    return quality.photo_coverage(_linked(spark, d))


@query("market_status", b.with_asks("""select 'unprojected_events' as measure, count(*) as n from asks where version_key % 3 <> 0 and not exists (select 1 from asks p where p.source = asks.source and p.source_id = asks.source_id and p.observed_at = asks.observed_at and p.version_key % 3 = 0)
  union all select 'issue: fuel is required', count(*) from asks where version_key % 3 = 0 and fuel is null union all select 'reviews', count(*) from fresh"""))
def market_status(spark, d):
    a = b.asks(spark, d)
    projected = a.filter("version_key % 3 = 0").withColumn("issue", F.when(F.col("fuel").isNull(), "fuel is required"))
    return quality.market_status(a, projected, b.fresh(spark, d), ("source", "source_id", "observed_at"))


@query("batch_state_counts", """select cast(date_trunc('month', o_orderdate) as date) as batch, count(*) as records, count(*) filter (o_orderstatus = 'F') as state_f, count(*) filter (o_orderstatus = 'O') as state_o, count(*) filter (o_orderstatus = 'P') as state_p from orders group by 1""")
def batch_state_counts(spark, d):
    o = b.table(spark, d, "orders").withColumn("batch", F.to_date(F.date_trunc("month", "o_orderdate")))
    return quality.state_counts(o, "batch", "o_orderstatus", ("F", "O", "P"))


@query("usage_ledger", """select strftime(o_orderdate, '%Y-%m') as month, cast(sum(coalesce(a, 50)) as bigint) as used_rows, count(*) filter (a is null) as open_reservations from orders left join (
  select l_orderkey k, cast(sum(l_quantity) as bigint) a from lineitem where l_linestatus = 'F' group by 1) on k = o_orderkey group by 1""")
def usage_ledger(spark, d):
    reservations = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("reserved_at"), F.lit(50).alias("cap"))
    imports = b.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_linestatus") == "F").alias("finished"), F.col("l_quantity").cast("bigint").alias("rows")
    )
    return quality.usage_ledger(reservations, imports)


@query("unique_listings", "select l_returnflag as source, count(distinct l_partkey) as unique_listings from lineitem group by 1")
def unique_listings(spark, d):
    li = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("source_id"))
    return quality.unique_listings(li)


@query("zero_yield_report", """with t as (select cast(date_trunc('day', ts) as date) as batch, user_id, event_type from events), f as (select min(batch) batch, count(*) over () from t group by user_id, event_type),
 n as (select batch, count(*) u from (select min(batch) batch from t group by user_id, event_type) group by batch), r as (select t.batch, count(*) as returned, coalesce(max(n.u), 0) as new_unique from t left join n using (batch) group by t.batch),
 z as (select *, returned > 0 and new_unique = 0 as zero, sum(case when returned > 0 and new_unique = 0 then 0 else 1 end) over (order by batch) island from r)
 select batch, returned, new_unique, cast(sum(case when zero then 1 else 0 end) over (partition by island order by batch) as bigint) as zero_yield_batches, sum(case when zero then 1 else 0 end) over (partition by island order by batch) >= 5 as pause from z""")
def zero_yield_report(spark, d):
    e = b.table(spark, d, "events")
    batches = quality.new_unique_per_batch(e, F.to_date("ts"), ("user_id", "event_type"))
    return quality.zero_yield_runs(batches, "batch")


_PRED = """pred as (select o_orderkey, concat('v', cast(o_orderkey as string)) as vehicle_id, o_orderstatus as segment, cast(round(o_totalprice * 100) as bigint) as predicted_cents, cast(s as bigint) as sold_cents,
 cast(floor(o_totalprice * 80) as bigint) as lo, cast(ceil(o_totalprice * 120) as bigint) as hi, o_orderkey % 17 = 0 as trained, o_orderkey % 19 = 0 as unattested, o_orderkey % 23 = 0 as leaked
 from orders join (select l_orderkey, sum(cast(round(l_extendedprice * 100) as bigint)) s from lineitem group by 1) on l_orderkey = o_orderkey)"""
_OK = "predicted_cents between 1 and 1000000000 and sold_cents between 1 and 1000000000 and lo between 0 and 1000000000 and hi between 0 and 1000000000"
_REASON = f"case when trained then 'vehicle missing or used in training' when unattested then 'sale not attested' when leaked then 'temporal leakage' when not (predicted_cents between 1 and 1000000000 and sold_cents between 1 and 1000000000) then 'prices must be positive' when not ({_OK}) then 'interval' end"


def _judged(spark, d):
    cents = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("sold_cents"))
    o = b.table(spark, d, "orders").join(cents, F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("o_orderkey")
    rows = o.select(
        "o_orderkey", F.concat(F.lit("v"), k).alias("vehicle_id"), F.lit("m1").alias("model_version"), (k % 19 != 0).alias("verified"), F.lit("reviewer").alias("verified_by"),
        F.lit("observed_transaction").alias("data_kind"), F.lit("https://records.example.com/1").alias("evidence_url"), F.col("o_orderdate").alias("training_cutoff"),
        F.col("o_orderdate").alias("predicted_at"), (F.col("o_orderdate") + F.when(k % 23 == 0, F.expr("interval -1 day")).otherwise(F.expr("interval 5 days"))).alias("sold_at"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("predicted_cents"), "sold_cents", F.floor(F.col("o_totalprice") * 80).cast("bigint").alias("interval_low_cents"),
        F.ceil(F.col("o_totalprice") * 120).cast("bigint").alias("interval_high_cents"), F.col("o_orderstatus").alias("segment"),
    )
    training = rows.filter(k % 17 == 0).select("vehicle_id")
    return evaluation.judge_predictions(rows, training, "m1", F.lit("2030-01-01").cast("timestamp"), ("o_orderkey",))


@query("prediction_acceptance", f"with {_PRED} select o_orderkey, {_REASON} as reason from pred")
def prediction_acceptance(spark, d):
    return _judged(spark, d).select("o_orderkey", "reason")


@query("holdout_evaluation", f"""with {_PRED}, a as (select *, abs(predicted_cents - sold_cents) e, greatest(0, predicted_cents - sold_cents) o from pred where {_REASON} is null)
 select case when grouping(segment) = 1 then 'overall' else 'segment' end as scope, segment, count(*) as n, cast(round_even(avg(e), 0) as bigint) as mae_cents, cast(quantile_disc(e, 0.9) as bigint) as p90_abs_error_cents,
 cast(round_even(avg(predicted_cents - sold_cents), 0) as bigint) as bias_cents, cast(quantile_disc(o, 0.9) as bigint) as p90_overpricing_cents, count(*) >= 30 as sufficient_sample,
 cast(floor(median(e / sold_cents * 100) * 1000 + 0.5) as bigint) as mdape_milli, cast(floor(avg(case when sold_cents between lo and hi then 1 else 0 end) * 10000 + 0.5) as bigint) as coverage_bp from a group by grouping sets ((), (segment))""")
def holdout_evaluation(spark, d):
    m = evaluation.error_metrics(_judged(spark, d).filter("reason is null"))
    return m.select(
        "scope", "segment", "n", "mae_cents", "p90_abs_error_cents", "bias_cents", "p90_overpricing_cents", "sufficient_sample",
        F.round(F.col("median_ape") * 1000).cast("bigint").alias("mdape_milli"), F.round(F.col("interval_coverage") * 10_000).cast("bigint").alias("coverage_bp"),
    )


@query("repair_underestimates", f"""with {_PRED} select count(*) as repair_samples, count(*) filter (sold_cents > predicted_cents) as repair_underestimates, cast(round_even(avg(greatest(sold_cents - predicted_cents, 0)), 0) as bigint) as mean_repair_underestimate_cents from pred where {_REASON} is null""")
def repair_underestimates(spark, d):
    good = _judged(spark, d).filter("reason is null").withColumns({"actual_repair_cents": F.col("sold_cents"), "predicted_repair_high_cents": F.col("predicted_cents")})
    return evaluation.repair_underestimates(good)


# Offers: suppliers quote parts; some quotes are stale, unavailable, foreign or for another tier.
_OFFER_OK = "l_shipdate between timestamp '2001-06-01' - interval 400 day and timestamp '2001-06-01' and l_linenumber <> 5 and l_tax < 0.075 and l_discount < 0.095"


def _offers(spark, d):
    li = b.table(spark, d, "lineitem")
    return li.select(
        F.col("l_partkey").alias("part_id"), F.concat(F.lit("https://shop"), F.col("l_suppkey"), F.lit(".example.com/"), F.col("l_orderkey")).alias("url"),
        F.concat(F.lit("Shop "), F.col("l_suppkey")).alias("seller"), F.concat(F.lit("S"), F.col("l_suppkey") % 40).alias("seller_group"),
        F.concat(F.lit("B"), F.col("l_linenumber") % 3).alias("brand"), F.concat(F.lit("C"), F.col("l_partkey")).alias("part_number"),
        F.array().cast("array<string>").alias("oem_cross_references"), F.col("l_shipdate").cast("timestamp").alias("observed_at"),
        F.when(F.col("l_tax") < 0.075, "EUR").otherwise("CHF").alias("currency"), F.lit(True).alias("vat_included"),
        F.when(F.col("l_linenumber") == 5, "sold out").otherwise("available").alias("availability"), F.lit("new").alias("condition"),
        F.when(F.col("l_discount") < 0.095, "original").otherwise("aftermarket").alias("tier"), F.lit("catalogue").alias("fitment_basis"),
        F.create_map().cast("map<string,string>").alias("attributes"), F.floor(F.col("l_extendedprice")).cast("bigint").alias("price_cents"),
        ((F.col("l_quantity").cast("bigint") % 4) + 1).alias("pack_quantity"), F.lit(500).cast("bigint").alias("shipping_cents"), F.lit(0).cast("bigint").alias("bulky_fee_cents"),
        F.when(F.col("l_returnflag") == "R", F.lit(0)).cast("bigint").alias("core_deposit_cents"), F.lit("live_page").alias("retrieval"),
    )


def _parts(spark, d):
    p = b.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("part_id"), (F.col("p_size") % 5 + 1).cast("bigint").alias("quantity"), F.lit("new").alias("condition"), F.lit("original").alias("tier"),
        F.concat(F.lit("c"), F.col("p_partkey")).alias("part_number"), F.create_map().cast("map<string,string>").alias("requirements"),
        F.floor("p_retailprice").cast("bigint").alias("fallback_low_cents"), (F.floor("p_retailprice") * 3).cast("bigint").alias("fallback_high_cents"),
        (F.col("p_size") % 3 != 0).alias("diagnosis_confirmed"), F.lit(True).alias("identity_confirmed"),
    )


_JUDGED = f"""j as (select l_partkey part_id, 'https://shop' || l_suppkey || '.example.com/' || l_orderkey url, 's' || (l_suppkey % 40) seller, 'b' || (l_linenumber % 3) brand, l_shipdate seen, l_returnflag = 'R' fees,
 cast(ceil((p_size % 5 + 1) / (cast(l_quantity as bigint) % 4 + 1)) as bigint) * cast(floor(l_extendedprice) as bigint) cost, p_size, p_retailprice, case when not (l_shipdate between timestamp '2001-06-01' - interval 400 day and timestamp '2001-06-01') then 'stale or future observation'
 when l_tax >= 0.075 then 'currency or VAT unresolved' when l_linenumber = 5 then 'stock not confirmed' when l_discount >= 0.095 then 'different tier' when floor(l_extendedprice) < 1 then 'zero price or unknown pack' end reason
 from lineitem join part on p_partkey = l_partkey)"""
_PARTS_AT = "2001-06-01"


@query("offer_acceptance", f"with {_JUDGED} select coalesce(reason, 'accepted') as reason, count(*) as n from j group by 1")
def offer_acceptance(spark, d):
    judged = parts.judge_offers(_parts(spark, d), _offers(spark, d), F.lit(_PARTS_AT).cast("timestamp"), 400)
    return judged.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("offer_dedup", f"with {_JUDGED} select part_id, seller, brand, seen as observed_at, cost as cost_cents from (select *, row_number() over (partition by part_id, seller, brand order by seen desc, cost, url) rn from j where reason is null) where rn = 1")
def offer_dedup(spark, d):
    from ..operators.dedup import newest_offer

    judged = parts.judge_offers(_parts(spark, d), _offers(spark, d), F.lit(_PARTS_AT).cast("timestamp"), 400).filter("reason is null")
    one = newest_offer(judged, ["part_id", "seller_key", F.lower("brand"), "code_key"], "observed_at", "cost_cents", ["url"])
    return one.select("part_id", F.col("seller_key").alias("seller"), F.lower("brand").alias("brand"), "observed_at", "cost_cents")


@query("parts_estimate", f"""with {_JUDGED}, o as (select * from (select *, row_number() over (partition by part_id, seller, brand order by seen desc, cost, url) rn from j where reason is null) where rn = 1),
 s as (select part_id, seller, median(cost) m, count(*) n, min(cost) lo, max(cost) hi, min(case when fees then cost + 500 end) dl from o group by 1, 2),
 g as (select part_id, count(*) k, sum(n) n, min(lo) lo, max(hi) hi, cast(round_even(median(m), 0) as bigint) typ, min(dl) dl from s group by 1),
 e as (select p_partkey part_id, coalesce(k, 0) as independent_sellers, cast(coalesce(n, 0) as bigint) as accepted_offers, case when lo is null then f when k >= 2 and p_size % 3 <> 0 then lo else least(f, lo) end as parts_low_cents,
   case when lo is null then f * 3 when k >= 2 and p_size % 3 <> 0 then hi else greatest(f * 3, hi) end as parts_high_cents, case when lo is null then (f + f * 3) // 2 else typ end t, lo as cheapest_cents, dl as cheapest_delivered_cents
   from (select *, cast(floor(p_retailprice) as bigint) f from part) left join g on g.part_id = p_partkey)
 select part_id, independent_sellers, accepted_offers, parts_low_cents, greatest(parts_low_cents, least(t, parts_high_cents)) as parts_typical_cents, parts_high_cents, cheapest_cents, cheapest_delivered_cents from e""")
def parts_estimate(spark, d):
    p = _parts(spark, d)
    judged = parts.judge_offers(p, _offers(spark, d), F.lit(_PARTS_AT).cast("timestamp"), 400)
    return parts.estimate_parts(p, judged).drop("basis", "uncertainty", "cheapest_url")


@query("parts_card", b.with_asks("""select source, source_id, (price_eur + 500) * 100 - price_eur * 100 - mileage_km as potential_gross_low_cents, (price_eur + 2500) * 100 - price_eur * 100 - mileage_km // 2 as potential_gross_high_cents from fresh where price_eur > 0"""))
def parts_card(spark, d):
    f = b.fresh(spark, d).filter("price_eur > 0").withColumns({
        "p25_eur": F.col("price_eur") + 500, "p75_eur": F.col("price_eur") + 2500, "parts_high_cents": F.col("mileage_km"), "parts_low_cents": F.floor(F.col("mileage_km") / 2).cast("bigint"),
    })
    return economics.parts_card(f).select("source", "source_id", "potential_gross_low_cents", "potential_gross_high_cents")
