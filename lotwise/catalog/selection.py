"""Sorting, paging, top-k and balanced selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import price_band
from ..operators import dedup, ordered, selection
from . import base as b
from .base import query


def leads(spark, d):
    """Every fresh total-price listing as a lead with a whole-number score."""
    return b.fresh(spark, d).filter("price_kind = 'total' and price_eur > 0").select(
        "source", "source_id", "make", "model", "year", "mileage_km", "price_eur", "version_text", "city", price_band("price_eur").alias("price_band"),
        (F.col("cents") % 97).alias("comparable_count"), (F.col("version_key") % 1009).cast("double").alias("score"), (F.col("version_key") % 1009).cast("double").alias("priority_score"),
        (F.col("version_key") % 200 == 0).alias("price_priority_passed"),
        F.when(F.col("version_key") % 10 < 6, "clean").when(F.col("version_key") % 10 < 8, "minimal").otherwise("non_severe").alias("damage_category"),
    )


_LEADS = """leads as (select *, least(3, price_eur // 5000) as price_band, cents % 97 as comparable_count, cast(version_key % 1009 as double) as score from fresh where price_kind = 'total' and price_eur > 0)"""


@query("multi_key_sort", b.with_asks("select source, source_id, row_number() over (order by fuel is not null desc, price_eur desc, mileage_km, source, source_id) as position from fresh"))
def multi_key_sort(spark, d):
    f = b.fresh(spark, d).select("source", "source_id", F.col("fuel").isNotNull().alias("has_fuel"), "price_eur", "mileage_km")
    order = [F.col("has_fuel").desc(), F.col("price_eur").desc(), F.col("mileage_km"), F.col("source"), F.col("source_id")]
    return ordered.ranked(f, [], order, "position").select("source", "source_id", "position")


@query("offset_limit_page", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 300")
def offset_limit_page(spark, d):
    return b.table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(300).limit(100).select("o_orderkey", "o_totalprice")


@query("top_k_with_counts", b.with_asks("select source, source_id, score, (select count(*) from leads) as total, greatest(0, 50 - (select count(*) from leads)) as shortage from leads order by score desc, comparable_count desc, source, source_id limit 50", _LEADS))
def top_k_with_counts(spark, d):
    rows = leads(spark, d)
    top = rows.orderBy(F.col("score").desc(), F.col("comparable_count").desc(), "source", "source_id").limit(50)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return top.select("source", "source_id", "score", F.lit(1).alias("_k")).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").select(
        "source", "source_id", "score", "total", F.greatest(F.lit(0), F.lit(50) - F.col("total")).alias("shortage")
    )


def _recursive(body: str, *ctes: str) -> str:
    return b.with_asks(body, *ctes).replace("with ", "with recursive ", 1).replace("run as materialized (", "run as (", 1)


# The whole leads in order, as one list; a step of the recursion takes the first that may be chosen.
def _pool(order: str) -> str:
    return f"""ranked as (select *, row_number() over (order by {order}, comparable_count desc, source, source_id) as i,
 case when version_key % 10 < 6 then 'clean' when version_key % 10 < 8 then 'minimal' else 'non_severe' end as damage_category, version_key % 200 = 0 as price_priority_passed from leads),
 pool as (select list(struct_pack(i := i, band := price_band, fam := coalesce(make, '') || '/' || coalesce(model, ''), cat := damage_category, first_price := price_priority_passed,
 offer := concat_ws('/', make, model, year, mileage_km, price_eur, coalesce(version_text, '-'), coalesce(city, '-'))) order by i) as p from ranked)"""


_ROUND_ROBIN = """run as (select 0 as t, []::bigint[] as ids, []::varchar[] as fams union all
 select t + 1, case when x is null then ids else list_append(ids, x.i) end, case when x is null then fams else list_append(fams, x.fam) end from (
 select t, ids, fams, list_filter(p, lambda r: r.band = t % 4 and not list_contains(ids, r.i) and len(list_filter(fams, lambda f: f = r.fam)) < 2)[1] as x from run, pool where t < 80 and len(ids) < 20))"""
_MIX = """seats as (select place, cat, fl + case when row_number() over (order by rest desc, place) <= 20 - sum(fl) over () then 1 else 0 end as n from (
 select place, cat, 20 * percent // 100 as fl, 20 * percent % 100 as rest from (values (0, 'clean', 30), (1, 'minimal', 20), (2, 'non_severe', 50)) v(place, cat, percent))),
 turns as (select row_number() over (order by place, k, band) as t, cat, n, band from (select place, cat, n, unnest(range(n)) as k from seats), (select unnest(range(4)) as band)),
 run as (select 1 as t, []::bigint[] as ids, []::varchar[] as fams, []::varchar[] as cats, []::varchar[] as offers union all
 select t + 1, case when x is null then ids else list_append(ids, x.i) end, case when x is null then fams else list_append(fams, x.fam) end, case when x is null then cats else list_append(cats, x.cat) end, case when x is null then offers else list_append(offers, x.offer) end
 from (select t, ids, fams, cats, offers, coalesce(list_filter(h, lambda r: len(list_filter(fams, lambda f: f = r.fam)) < 2)[1], h[1]) as x from (
 select t, ids, fams, cats, offers, case when len(list_filter(cats, lambda c: c = cat)) < n then list_filter(p, lambda r: r.cat = cat and r.band = turns.band and not list_contains(offers, r.offer)) end as h from run join turns using (t), pool)))"""


def _balanced(first: str) -> str:
    return f"""run as (select 0 as pass, []::bigint[] as ids, []::varchar[] as fams, []::bigint[] as bands union all
 select case when x is null then pass + 1 else pass end, case when x is null then ids else list_append(ids, x.i) end, case when x is null then fams else list_append(fams, x.fam) end, case when x is null then bands else list_append(bands, x.band::bigint) end
 from (select pass, ids, fams, bands, list_filter(p, lambda r: not list_contains(ids, r.i) and (pass <> 0 or {first}) and (pass not in (1, 2) or len(list_filter(bands, lambda q: q = r.band)) < 10)
 and (pass not in (1, 3) or len(list_filter(fams, lambda f: lower(f) = lower(r.fam))) < 4))[1] as x from run, pool where pass < 5 and len(ids) < 40))"""


def _chosen(columns: str, rank: str = "k") -> str:
    return f"select {columns}, (row_number() over (order by {rank}))::int as selection_rank from (select unnest(ids) as i, generate_subscripts(ids, 1) as k from (select ids from run order by len(ids) desc limit 1)) join ranked using (i)"


@query("round_robin_bands", _recursive(_chosen("source, source_id, price_band::int as price_band, make, model"), _LEADS, _pool("score desc"), _ROUND_ROBIN))
def round_robin_bands(spark, d):
    return selection.round_robin_bands(leads(spark, d), "score", 20).select("source", "source_id", "price_band", "make", "model", "selection_rank")


@query("damage_mix_selection", _recursive(_chosen("source, source_id, damage_category, price_band::int as price_band"), _LEADS, _pool("score desc"), _MIX))
def damage_mix_selection(spark, d):
    return selection.damage_mix_selection(leads(spark, d), 20).select("source", "source_id", "damage_category", "price_band", "selection_rank")


@query("evidence_balanced_select", _recursive(_chosen("source, source_id, price_band::int as price_band, price_priority_passed, score", "i"), _LEADS, _pool("version_key % 200 = 0 desc, score desc"), _balanced("r.first_price")))
def evidence_balanced_select(spark, d):
    return selection.evidence_balanced_select(leads(spark, d), 40).select("source", "source_id", "price_band", "price_priority_passed", "score", "selection_rank")


@query("damage_mix_counts", _recursive("select damage_category, count(*) as n from (" + _chosen("damage_category") + ") group by 1", _LEADS, _pool("score desc"), _MIX))
def damage_mix_counts(spark, d):
    return selection.damage_mix_selection(leads(spark, d), 20).groupBy("damage_category").agg(F.count(F.lit(1)).alias("n"))


@query("selection_summary", _recursive("""select price_band, available, 10 as target, selected, greatest(0, 10 - selected) as shortage, greatest(0, selected - 10) as redistributed, (select max(n) > 4 from (select count(*) as n from picked group by lower(make), lower(model))) as family_cap_relaxed
 from (select price_band, count(*) as available from ranked group by 1) join (select price_band, count(*) as selected from picked group by 1) using (price_band)""", _LEADS, _pool("score desc"), _balanced("false"), "picked as (" + _chosen("price_band, make, model", "i") + ")"))
def selection_summary(spark, d):
    rows = leads(spark, d).withColumn("price_priority_passed", F.lit(False))
    out = selection.selection_summary(rows, selection.evidence_balanced_select(rows, 40), 40)
    return out.select(*(F.col(c).cast("bigint").alias(c) for c in ("price_band", "available", "target", "selected", "shortage", "redistributed")), "family_cap_relaxed")


@query("apportionment", """with s as (select n_regionkey, count(*) n from customer join nation on n_nationkey = c_nationkey group by 1), t as (select *, 17 * n as raw, sum(n) over () tot from s), f as (select *, raw // tot fl, raw % tot rest from t),
 r as (select *, row_number() over (order by rest desc, n_regionkey) rn, 17 - sum(fl) over () leftover from f) select n_regionkey, cast(fl + case when rn <= leftover then 1 else 0 end as bigint) as seats from r""")
def apportionment(spark, d):
    c, n = b.table(spark, d, "customer"), b.table(spark, d, "nation")
    shares = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return selection.apportion(shares, "n", 17, ["n_regionkey"]).select("n_regionkey", F.col("seats").cast("bigint").alias("seats"))


@query("union_distinct", "select o_orderkey, min(side) as side from (select o_orderkey, 0 as side from orders where o_custkey % 2 = 0 union all select o_orderkey, 1 from orders where o_custkey % 3 = 0) group by 1")
def union_distinct(spark, d):
    o = b.table(spark, d, "orders")
    left = o.filter("o_custkey % 2 = 0").select("o_orderkey", F.lit(0).alias("side"))
    right = o.filter("o_custkey % 3 = 0").select("o_orderkey", F.lit(1).alias("side"))
    return dedup.union_distinct(left, right, ["o_orderkey"])


@query("checksum_status", """select source, arrivals, case when lo <> hi then 'conflicting_content' when arrivals > 1 then 'repeated' else 'new' end as status, n from (select source, arrivals, lo, hi, 1 n from (
 select concat(source, '/', cast(doc_id % 20 as string)) as source, count(*) arrivals, min(sha256(text)) lo, max(sha256(text)) hi from documents group by 1))""")
def checksum_status(spark, d):
    docs = b.table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id") % 20).alias("source"), F.sha2("text", 256).alias("h"))
    return dedup.checksum_status(docs, ["source"], "h").withColumn("n", F.lit(1))


@query("content_assets", "select sha256(text) as sha, octet_length(encode(text)) as byte_count, min(doc_id) as first_saved, count(*) as reference_count from documents group by 1, 2")
def content_assets(spark, d):
    out = dedup.content_assets(b.table(spark, d, "documents"), "text", "doc_id")
    return out.withColumn("byte_count", F.col("byte_count").cast("bigint"))


_ASSETS = "assets as (select sha256(text) as sha, octet_length(encode(text)) as byte_count, min(timestamp '2024-01-01' + to_seconds(doc_id * 977)) as first_saved from documents group by 1, 2)"


@query("storage_cap", f"with {_ASSETS}, r as (select *, sum(byte_count) over (order by first_saved, sha rows unbounded preceding) rb from assets) select sha, cast(rb as bigint) as running_bytes, rb <= 1000000 as stored from r")
def storage_cap(spark, d):
    docs = b.table(spark, d, "documents").withColumn("saved", F.timestamp_seconds(F.col("doc_id") * 977 + 1_704_067_200))
    assets = dedup.content_assets(docs, "text", "saved")
    return dedup.within_storage_cap(assets, 1_000_000).select("sha", F.col("running_bytes").cast("bigint").alias("running_bytes"), "stored")


@query("ordered_distinct_terms", r"select doc_id, len(list_distinct(string_split(text, ' '))) as distinct_terms, len(list_filter(['the', 'of', 'und'], lambda x: not list_contains(string_split(text, ' '), x))) as missing_terms from documents")
def ordered_distinct_terms(spark, d):
    words = F.split("text", " ")
    need = F.array(*[F.lit(w) for w in ("the", "of", "und")])
    return b.table(spark, d, "documents").select(
        "doc_id", F.size(F.array_distinct(words)).cast("bigint").alias("distinct_terms"), F.size(F.array_except(need, words)).cast("bigint").alias("missing_terms")
    )
