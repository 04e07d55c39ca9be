"""End-to-end screens, shortlists and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import peers, selection, stats
from ..plans import discovery, market, reports, research, third_party
from . import base as b
from .aggregates import benchmark_ctes
from ..session import cut_lineage
from .base import query
from .joins import NOT_SELF, near_sql
from .predicates import _RISK, _USABLE

COHORT = ("make", "seller_type")


def _screen_sql() -> str:
    local = benchmark_ctes("lo", f"t.source = p.source and t.make = p.make and t.seller_type = p.seller_type and t.province = p.province and {near_sql(1, 20000)}", "2.0", "valid", "hp")
    nation = benchmark_ctes("na", f"t.source = p.source and t.make = p.make and t.seller_type = p.seller_type and {near_sql(1, 20000)}", "2.0", "rest", "hp")
    return b.with_asks(
        """select source, source_id, scope, reason, comparable_count, case when reason in ('below_asking_market', 'discount_too_small') then cast(floor((p25 - price_eur) / p25 * 10000 + 0.5) as bigint) end as discount_bp,
 case when reason = 'below_asking_market' then 'verification' when reason in ('insufficient_comparables', 'condition_unresolved') then 'enrichment' else 'screened_out' end as route from (select *, case when price_kind <> 'total' or price_eur not between 1000 and 50000 then 'outside_purchase_scope'
 when condition = 'unknown' then 'condition_unresolved' when benchmark_issue is not null then 'insufficient_comparables' when (p25 - price_eur) * 10 >= p25 then 'below_asking_market' else 'discount_too_small' end as reason from (select *, 'province' as scope from lo where benchmark_issue is null union all select *, 'national' from na))""",
        "valid as (select * from fresh where generation is not null and fuel is not null and price_eur between 1 and 10000000)",
        "hp as (select * from valid where price_kind = 'total' and condition = 'undamaged')", local, "rest as (select * from valid f where not exists (select 1 from lo where lo.source = f.source and lo.source_id = f.source_id and lo.benchmark_issue is null))", nation,
    )


def _market(spark, d):
    return market.market_screen(b.asks(spark, d), b.as_of(), cohort=COHORT, window_days=b.WINDOW_DAYS, max_dispersion=2.0, ties=b.TIES)


@query("market_screen", _screen_sql())
def market_screen(spark, d):
    s = _market(spark, d)
    points = F.floor((F.col("p25") - F.col("price_eur")) / F.col("p25") * 10_000 + 0.5).cast("bigint")
    return s.select("source", "source_id", "scope", "reason", "comparable_count", F.when(F.col("discount_fraction").isNotNull(), points).alias("discount_bp"), "route")


@query("market_screen_routes", "select route, n from (" + _screen_sql().replace("select source, source_id, scope, reason, comparable_count, case when reason in ('below_asking_market', 'discount_too_small') then cast(floor((p25 - price_eur) / p25 * 10000 + 0.5) as bigint) end as discount_bp,\n case when", "select route, count(*) as n from (select case when", 1) + ") group by route)")
def market_screen_routes(spark, d):
    return _market(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("mileage_band_anchors", b.with_asks("""select make, band, anchor_km, n from (select make, band, list_sort(list(mileage_km))[count(*) // 2 + 1] as anchor_km, count(*) as n from (select make, mileage_km, case when mileage_km < 60000 then 'low' when mileage_km < 150000 then 'medium' else 'high' end as band from fresh) group by 1, 2)"""))
def mileage_band_anchors(spark, d):
    f = b.fresh(spark, d)
    t = market.mileage_band_targets(f.select("make").distinct().withColumn("mileage_km", F.lit(0).cast("bigint")), f, ["make"])
    n = f.withColumn("band", F.when(F.col("mileage_km") < 60_000, "low").when(F.col("mileage_km") < 150_000, "medium").otherwise("high")).groupBy("make", "band").agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, ["make", "band"]).select("make", "band", "anchor_km", "n")


@query("mileage_band_benchmarks", b.with_asks("select source, source_id, band, comparable_count, benchmark_issue from bm", """banded as (select *, case when mileage_km < 60000 then 'low' when mileage_km < 150000 then 'medium' else 'high' end as band from fresh)""",
 "anc as (select make, band, list_sort(list(mileage_km))[count(*) // 2 + 1] as a from banded group by 1, 2)",
 "anch as (select f.* replace (coalesce(a, f.mileage_km) as mileage_km, concat(f.source, '/', z.band) as source), z.band, f.source as osource from fresh f cross join (values ('low'), ('medium'), ('high')) z(band) left join anc on anc.make = f.make and anc.band = z.band)",
 benchmark_ctes("bx", f"t.make = p.make and t.seller_type = p.seller_type and t.band = p.band and (t.osource <> p.source or t.source_id <> p.source_id) and p.price_kind = 'total' and p.condition = 'undamaged' and {near_sql(1, 20000)}", "2.0", "anch", "banded").replace(f" and {NOT_SELF}", ""),
 "bm as (select osource as source, source_id, band, comparable_count, benchmark_issue from bx)"))
def mileage_band_benchmarks(spark, d):
    f = b.fresh_once(spark, d)
    out = market.mileage_band_benchmarks(f, f, b.as_of(), ["make"], ("make", "seller_type"), max_dispersion=2.0, window_days=b.WINDOW_DAYS)
    return out.select("source", "source_id", "band", "comparable_count", "benchmark_issue")


@query("market_experts", b.with_asks(" union all ".join(
    f"""select t.source, t.source_id, '{name}' as "view", count(p.source) as comparable_count, min(p.price_eur) as envelope_low_eur, max(p.price_eur) as envelope_high_eur from fresh t left join fresh p on t.make = p.make and t.seller_type = p.seller_type {extra} and {near_sql(1, 20000)} and {NOT_SELF} and p.price_kind = 'total' and p.condition = '{cond}' group by 1, 2"""
    for name, cond, extra in (("healthy_province", "undamaged", "and t.province = p.province"), ("healthy_national", "undamaged", ""), ("damaged_province", "damaged", "and t.province = p.province")))))
def market_experts(spark, d):
    f = b.fresh_once(spark, d)
    pool = f.filter("price_kind = 'total'")
    out = market.market_experts(f, pool, b.as_of(), COHORT, max_dispersion=2.0, window_days=b.WINDOW_DAYS)
    return out.select("source", "source_id", "view", "comparable_count", "envelope_low_eur", "envelope_high_eur")


def _research_rows(spark, d):
    """Fresh listings as they are, with their whole texts, prices and stated fields.

    A variant here is brand, fuel, gearbox, seller type and generation, so that it grows with the tables;
    headlines and engine figures, under which these tables have next to no peers, are those of
    ``strict_variant_peers``.
    """
    return b.fresh(spark, d).select(
        "source", "source_id", "observed_at", "active", "make", F.lit("all").alias("model"), "fuel", "transmission", "seller_type", "year", "mileage_km", "price_eur", "price_kind", "city",
        "condition", "title", "description", "generation", F.lit("base").alias("trim"), F.lit(None).cast("string").alias("version_text"), F.lit("unknown").alias("damage_severity"),
    )


@query("price_context")
def price_context(spark, d):
    prepared = cut_lineage(research.prepare(_research_rows(spark, d), "exploratory"), "prepared")
    return research.research_contexts(prepared, "exploratory").select("source", "source_id", "cohort_count", "context_count", "method", "confidence", "asking_low_eur", "asking_typical_eur", "asking_high_eur", "validation_error_eur")


_RR = f"""rr as (select * from fresh where {_USABLE} and condition <> 'damaged' and not {b.declared_sql("concat(title, ' ', description)", _RISK)} and fuel is not null and transmission is not null)"""


@query("price_context_counts", b.with_asks("""select t.source, t.source_id, count(distinct (p.year, p.mileage_km, p.price_eur, p.city)) as cohort_count, count(distinct (p.year, p.mileage_km, p.price_eur, p.city)) filter (abs(t.year - p.year) <= 2 and abs(t.mileage_km - p.mileage_km) <= 40000) as context_count
 from rr t join rr p on t.make = p.make and t.fuel = p.fuel and t.transmission = p.transmission and t.seller_type = p.seller_type and t.generation = p.generation and (t.source <> p.source or t.source_id <> p.source_id) where t.price_eur between 1000 and 20000 group by 1, 2 having context_count > 0""", _RR))
def price_context_counts(spark, d):
    return price_context(spark, d).select("source", "source_id", "cohort_count", "context_count")


@query("learning_summary")
def learning_summary(spark, d):
    return stats.learning_summary(price_context(spark, d))


@query("research_strict")
def research_strict(spark, d):
    return research.research_leads(_research_rows(spark, d), "strict").select("source", "source_id", "price_band", "comparable_count", "asking_low_eur", "gross_headroom_eur")


@query("research_exploratory")
def research_exploratory(spark, d):
    leads = research.research_leads(_research_rows(spark, d), "exploratory")
    return research.research_selection(leads, "exploratory", 20).select("source", "source_id", "price_band", "comparable_count", "gross_headroom_eur", "selection_rank")


@query("research_opportunities")
def research_opportunities(spark, d):
    leads = research.research_leads(_research_rows(spark, d), "opportunities")
    return research.research_selection(leads, "opportunities", 20).select("source", "source_id", "damage_category", "price_band", "priority_score", "selection_rank")


def _discovery_rows(spark, d):
    # The catalogue description stays; matching runs on make, model and stated specifications.
    return b.fresh(spark, d).withColumn("damage_severity", F.lit("unknown"))


@query("discovery_leads")
def discovery_leads(spark, d):
    leads = discovery.discovery_leads(_discovery_rows(spark, d), b.as_of())
    return leads.select("source", "source_id", "comparable_count", "asking_typical_eur", "gross_headroom_eur", "price_priority_passed", "score", "price_band")


@query("discovery_report")
def discovery_report(spark, d):
    leads = discovery.discovery_leads(_discovery_rows(spark, d), b.as_of())
    return selection.evidence_balanced_select(leads.drop("judgment", "damage_evidence", "blocking_reasons", "uncertainty_flags"), 40).select("source", "source_id", "price_band", "score", "selection_rank")


@query("collection_price_screen")
def collection_price_screen(spark, d):
    f = cut_lineage(_discovery_rows(spark, d), "fresh")
    new, old = f.filter("version_key % 5 = 0"), f.filter("version_key % 5 <> 0")
    return discovery.collection_screen(new, old).select("source", "source_id", "screen_status", "comparable_count", "detail_fetch_recommended")


def _third(spark, d):
    # Headlines are left out, so that families hold comparable cars; half of the adverts give a unit-less mileage.
    f = b.fresh(spark, d).withColumns({
        "title": F.lit(""), "version_text": F.lit(None).cast("string"), "model": F.lit("all"), "make": F.floor(F.col("source_id").cast("bigint") / 1000).cast("string"), "generation": F.lit(None).cast("string"), "displacement_cc": F.lit(None).cast("bigint"), "raw_miles": F.when(F.col("version_key") % 2 == 0, F.col("mileage_km").cast("double")),
        "seller_conflicts": F.array().cast("array<string>"),
    })
    unlabelled = F.when(F.col("raw_miles").isNull(), F.col("mileage_km"))
    return f.filter("source = 'a'").withColumn("mileage_km", unlabelled), f.filter("source <> 'a'")


@query("third_party_report")
def third_party_report(spark, d):
    adverts, offers = _third(spark, d)
    out = third_party.top_candidates(third_party.third_party_candidates(adverts, offers, b.as_of(), b.WINDOW_DAYS))
    return out.select("source", "source_id", "comparable_count", "lowest_comparable_asking_eur", "maximum_margin_before_unknown_costs_eur", F.array_join("blocking_reasons", ",").alias("blockers"))


@query("third_party_exclusions")
def third_party_exclusions(spark, d):
    adverts, offers = _third(spark, d)
    return third_party.exclusion_counts(adverts, offers, b.as_of(), b.WINDOW_DAYS)


_RUNS = f"runs as (select source, source_id, observed_at, version_key as run_id, observed_at + to_hours(6) as finished_at, case when version_key % 3 = 0 then 'screened_out' else 'verification' end as route, make, price_eur, case when version_key % 4 = 0 then cents end as conservative_margin_low_cents, price_eur * 10 as potential_gross_low_cents from asks where observed_at <= {b.AS_OF_SQL})"


def _runs(spark, d):
    k = F.col("version_key")
    return b.asks(spark, d).filter(F.col("observed_at") <= b.as_of()).select(
        "source", "source_id", "observed_at", k.alias("run_id"), (F.col("observed_at") + F.expr("interval 6 hours")).alias("finished_at"), b.as_of().alias("as_of"), F.when(k % 3 == 0, "screened_out").otherwise("verification").alias("route"),
        "make", "price_eur", F.when(k % 4 == 0, F.col("cents")).alias("conservative_margin_low_cents"), (F.col("price_eur") * 10).alias("potential_gross_low_cents"), F.lit(False).alias("professional_policy_ready"),
    )


@query("candidate_cards", b.with_asks("""select c.source, c.source_id, c.run_id, coalesce(conservative_margin_low_cents, potential_gross_low_cents, 0) as merit from (select * from (select *, row_number() over (partition by source, source_id order by finished_at desc, run_id desc) rn from runs) where rn = 1) c
 join latest l on l.source = c.source and l.source_id = c.source_id and l.observed_at = c.observed_at and l.active where route = 'verification' and c.price_eur <= 9000 order by conservative_margin_low_cents is not null desc, merit desc, c.observed_at desc, c.source, c.source_id limit 100""", _RUNS))
def candidate_cards(spark, d):
    cards = reports.candidate_cards(_runs(spark, d), b.latest(spark, d), b.as_of(), {"max_price_eur": 9000})
    merit = F.coalesce("conservative_margin_low_cents", "potential_gross_low_cents", F.lit(0))
    return reports.rank_cards(cards).select("source", "source_id", "run_id", merit.alias("merit"))


@query("publication_preview", b.with_asks(f"""select reasons, count(*) as n from (select array_to_string(list_filter([case when j.version_key % 5 = 0 then 'analysis_not_completed' end, case when j.version_key % 7 = 0 then 'supervisor_approval_missing' end,
 case when not (l.active and l.observed_at = j.observed_at) then 'source_removed_or_superseded' end, case when l.active and l.observed_at = j.observed_at and l.observed_at < {b.AS_OF_SQL} - interval 24 hour then 'source_older_than_24_hours' end], lambda x: x is not null), ',') as reasons
 from (select * from (select *, row_number() over (partition by source, source_id order by version_key desc) rn from (select distinct on (source, source_id, version_key) * from asks where observed_at <= {b.AS_OF_SQL} order by source, source_id, version_key, observed_at)) where rn = 1) j join latest l using (source, source_id)) group by 1"""))
def publication_preview(spark, d):
    from ..operators.temporal import pick_first

    k = F.col("job_id")
    one = pick_first(b.asks(spark, d).filter(F.col("observed_at") <= b.as_of()), ["source", "source_id", "version_key"], [F.col("observed_at")])
    rich = F.lit(10**9).cast("bigint")
    jobs = one.select("source", "source_id", "observed_at", F.col("version_key").alias("job_id"), "price_eur").withColumns({
        "batch_id": F.lit("b"), "state": F.when(k % 5 == 0, "failed").otherwise("done"), "run_as_of": b.as_of(), "supervisor_ok": k % 7 != 0, "gate_open": F.lit(True), "price_eur": F.lit(5000).cast("bigint"),
        "forecast_profit_cents": rich, "forecast_profit_low_cents": rich, "stressed_margin_cents": rich, "review_blockers": F.array().cast("array<string>"),
    })
    out = reports.publication_preview(jobs, b.latest(spark, d), b.as_of())
    return out.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("collection_audit", b.with_asks("""select source, source_id, observation_count, last_seen, coalesce(c, 0) as price_change_count, coalesce(s, 0) as net_change_eur from (select source, source_id, count(*) as observation_count, max(observed_at) as last_seen from asks group by 1, 2)
 left join (select source, source_id, count(*) c, cast(sum(price_eur - pp) as bigint) s from (select *, lag(price_eur) over w pp, lag(price_kind) over w pk from asks window w as (partition by source, source_id order by observed_at, version_key, cents)) where pk = 'total' and price_kind = 'total' and pp <> price_eur group by 1, 2) using (source, source_id)"""))
def collection_audit(spark, d):
    listings = b.latest(spark, d).withColumn("image_urls", F.array(F.concat(F.lit("https://p.example.com/"), "version_key")))
    out = reports.collection_audit(b.asks(spark, d), listings, b.TIES)
    return out.select("source", "source_id", "observation_count", "last_seen", "price_change_count", "net_change_eur")


@query("report_execution", b.with_asks("""select f.source, f.source_id, cast(arg_max(a.version_key, a.version_key) as bigint) as job_id, count(*) as photo_references, count(distinct a.price_eur) as distinct_assets from fresh f join asks a using (source, source_id) where least(3, f.price_eur // 5000) = 1 group by 1, 2"""))
def report_execution(spark, d):
    from ..functions.money import price_band

    f = b.fresh(spark, d).select("source", "source_id", price_band("price_eur").alias("price_band"))
    all_runs = f.withColumn("run_id", F.lit("r2")).withColumn("as_of", b.as_of()).unionByName(f.withColumn("run_id", F.lit("r1")).withColumn("as_of", F.lit("2000-01-01").cast("timestamp")))
    a = b.asks(spark, d)
    jobs = a.select("source", "source_id", F.col("version_key").alias("job_id"), F.lit("done").alias("state"), F.lit(1).alias("attempt"))
    shots = a.select("source", "source_id", F.sha2(F.col("price_eur").cast("string"), 256).alias("sha"))
    out = reports.filter_report(reports.report_execution(all_runs, jobs, shots), price_band=1)
    return out.select("source", "source_id", "job_id", "photo_references", "distinct_assets")


