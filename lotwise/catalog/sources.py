"""Readers, mappers and sinks exercised on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as doc
from ..session import shared_folder
from ..sources import importers, mappers, photos, sinks
from . import base as b
from .base import query


def _listings(spark, d):
    """Orders as listings of the import schema."""
    o = b.table(spark, d, "orders")
    text = {n: F.lit("x") for n in ("model", "generation", "trim", "transmission", "province", "seller_type", "condition")}
    return o.select(
        F.lit("csv").alias("source"), F.col("o_orderkey").cast("string").alias("source_id"), F.concat(F.lit("https://a.example/"), "o_orderkey").alias("url"), F.lower("o_orderstatus").alias("make"),
        F.lit("benzina").alias("fuel"), *[v.alias(k) for k, v in text.items() if k not in ("seller_type", "condition")], F.lit("dealer").alias("seller_type"), F.lit("undamaged").alias("condition"),
        F.lit("say \"hello\", ok").alias("title"), F.year("o_orderdate").cast("bigint").alias("year"), F.col("o_custkey").alias("mileage_km"), (F.floor("o_totalprice") + 1).cast("bigint").alias("price_eur"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"), F.lit(True).alias("active"),
    )


_IMPORT_SQL = "select cast(o_orderkey as string) as source_id, lower(o_orderstatus) as make, 'petrol' as fuel, o_custkey as mileage_km, cast(floor(o_totalprice) as bigint) + 1 as price_eur, 'say \"hello\", ok' as title from orders"
_IMPORTED = ("source_id", "make", "fuel", "mileage_km", "price_eur", "title")


@query("import_csv", _IMPORT_SQL)
def import_csv(spark, d):
    path = shared_folder(spark, "csv")
    _listings(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return importers.import_listings(spark, path, "csv", F.lit("2030-01-01").cast("timestamp")).select(*_IMPORTED)


@query("import_json", _IMPORT_SQL)
def import_json(spark, d):
    path = shared_folder(spark, "json")
    _listings(spark, d).write.json(path)
    return importers.import_listings(spark, path, "jsonl", F.lit("2030-01-01").cast("timestamp")).select(*_IMPORTED)


@query("import_counts", "select count(*) as received, count(*) filter (o_orderkey % 3 <> 0) as inserted, count(*) filter (o_orderkey % 3 = 0) as duplicates from orders")
def import_counts(spark, d):
    rows = _listings(spark, d)
    return importers.import_counts(rows, rows.filter(F.col("source_id").cast("bigint") % 3 == 0))


@query("read_export", "select concat(event_type, '-', cast(event_id // 2000 as string)) as source, cast(event_id as string) as source_id, cast(event_id % 2000 // 500 as bigint) as page_no, event_id % 2000 // 500 = max(event_id % 2000 // 500) over (partition by event_type, event_id // 2000) as complete from events")
def read_export(spark, d):
    # One export per event type and 2000 consecutive ids, in pages of 500 ids: bounded documents.
    part = F.floor(F.col("event_id") / 2000)
    e = b.table(spark, d, "events").select(F.concat("event_type", F.lit("-"), part).alias("source"), F.floor(F.col("event_id") % 2000 / 500).alias("page"), F.struct(
        F.col("event_id").cast("string").alias("source_id"), F.lit("2024-01-01T00:00:00Z").alias("observed_at"), F.lit("https://a.example/1").alias("url"), F.lit(True).alias("active"), F.col("props").alias("payload")
    ).alias("r"))
    pages = e.groupBy("source", "page").agg(F.collect_list("r").alias("rs"))
    export = pages.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page", "rs"))).alias("ps")).select("source", F.transform("ps", lambda p: p["rs"]).alias("pages"))
    path = shared_folder(spark, "export")
    export.write.json(path)
    out = importers.read_export(spark, path, whole_file=False)
    return out.select("source", "source_id", F.col("page_no").cast("bigint").alias("page_no"), "complete")


@query("field_map_reader", """select event_id, case when k % 2 = 0 and k > 0 then k end as price_eur, case k % 3 when 0 then 'petrol' when 1 then 'diesel' end as fuel, k as mileage_km from (select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events)""")
def field_map_reader(spark, d):
    k = doc.at(F.try_parse_json("props"), "k")
    item = F.concat(F.lit('{"car":[{"km":"'), k, F.lit('"}],"fuel":"'), (k.cast("bigint") % 3).cast("string"), F.lit('","price":{"v":'), k, F.lit('.0,"unit":"'), F.when(k.cast("bigint") % 2 == 0, "EUR").otherwise("CHF"), F.lit('"}}'))
    items = b.table(spark, d, "events").select("event_id", F.try_parse_json(item).alias("item"))
    mapping = {
        "price_eur": {"path": "price.v", "require": {"path": "price.unit", "value": "EUR"}}, "fuel": {"path": "fuel", "values": {"0": "petrol", "1": "diesel"}}, "mileage_km": "car.0.km",
    }
    return mappers.map_fields(items, mapping)


_NATIVE = """concat('{"id":"', l_orderkey, '","vehicle":{"make":"Fiat","model":"Panda","modelVersionInput":"', p_name, '","mileageInKmRaw":', cast(l_quantity as bigint) * 1000, ',"rawPowerInHp":"', 60 + p_size, '","firstRegistrationDateRaw":"', 1940 + p_size * 2, '-05-01","isCurrentlyDamaged":',
 case when l_linenumber = 5 then 'true' when l_linenumber = 6 then 'null' else 'false' end, '},"prices":{"isFinalPrice":', case when l_linenumber = 7 then 'false' else 'true' end, ',"public":{"priceRaw":', cast(l_extendedprice as bigint), ',"price":"', case when l_suppkey % 5 = 0 then 'CHF' else '€ 1' end,
 '","onRequestOnly":false}},"price":{"isConditionalPrice":', case when l_suppkey % 7 = 0 then '"no"' else 'false' end, '},"seller":{"type":"', case when l_linestatus = 'F' then 'Dealer' else 'Other' end, '"},"status":"Active","description":"', case when l_partkey % 9 = 0 then 'solo con finanziamento' else 'ok' end, '"}')"""


@query("native_listing_mapper", """select l_orderkey, l_linenumber, count(*) as n, max(cast(l_quantity as bigint) * 1000) as mileage_km, max(60 + p_size) as power_hp, max(case when 1940 + p_size * 2 between 1950 and 2002 then 1940 + p_size * 2 end) as year,
 max(case when l_suppkey % 5 <> 0 then cast(floor(l_extendedprice) as bigint) end) as price_eur, count(*) filter (l_suppkey % 5 <> 0 and l_suppkey % 7 <> 0 and l_linenumber <> 7 and l_partkey % 9 <> 0) as firm_prices,
 max(case when l_linenumber = 5 then 'damaged' when l_linenumber = 6 then 'unknown' else 'undamaged' end) as condition, max(case when l_linestatus = 'F' then 'dealer' end) as seller_type from lineitem join part on p_partkey = l_partkey group by 1, 2""")
def native_listing_mapper(spark, d):
    li = b.table(spark, d, "lineitem").join(b.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    items = li.select("l_orderkey", "l_linenumber", F.try_parse_json(F.expr(_NATIVE)).alias("item"))
    m = mappers.native_listing(items, b.as_of())
    return m.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.max("mileage_km").alias("mileage_km"), F.max("power_hp").alias("power_hp"), F.max("year").alias("year"), F.max("price_eur").alias("price_eur"),
        F.count_if(F.col("price_kind") == "total").alias("firm_prices"), F.max("condition").alias("condition"), F.max("seller_type").alias("seller_type"),
    )


def _provider(spark, d):
    """One provider row per advert text."""
    k = F.col("doc_id")
    return b.adverts(spark, d).select(
        "doc_id", F.concat(F.lit("https://m.example.com/item/"), k, F.lit("/?ref=x")).alias("url"), F.when(k % 13 == 0, F.lit("0")).otherwise(k.cast("string")).alias("product_id"), "title", "description",
        F.lit(None).cast("double").alias("initial_price"), (k * 37 % 21_000 + F.when(k % 17 == 0, 0.5).otherwise(0)).cast("double").alias("final_price"), F.when(k % 19 == 0, "CHF").otherwise("EUR").alias("currency"), F.lit("IT").alias("country_code"),
        F.when(k % 2 == 0, F.array(F.lit("Auto"))).otherwise(F.array().cast("array<string>")).alias("breadcrumbs"), F.array(F.lit("https://p.example.com/1.jpg")).alias("images"), F.when(k % 23 != 0, k % 29 == 0).alias("is_sold"),
        F.when(k % 24 == 10, 85_000.0).otherwise(120_000.0).alias("car_miles"), F.when(k % 3 != 0, "MANUAL").alias("transmission"), F.lit("USED").alias("condition"), F.lit(None).cast("string").alias("location_issue"),
    )


_PROV = """p as (select doc_id k, phrases, doc_id * 37 % 21000 + case when doc_id % 17 = 0 then 0.5 else 0 end as amount from adverts)"""
_PROV_ISSUE = """case when k % 2 = 1 and (k % 12 = 10 or k % 3 = 0 or regexp_matches(phrases, '(ricambi|smembro)')) then 'car category not verified' when k % 13 = 0 and k <> 0 then 'listing id and url conflict' when k % 19 = 0 then 'explicit EUR required'
 when amount <= 0 or k % 17 = 0 then 'invalid EUR price' when amount >= 20000 then 'price not below 20000 EUR' when k % 23 = 0 then 'explicit sold status required' when k % 29 = 0 then 'sold listing' end"""


@query("provider_row_mapper", b.with_adverts(f"select k as doc_id, {_PROV_ISSUE} as issue from p", _PROV))
def provider_row_mapper(spark, d):
    return mappers.provider_listing(_provider(spark, d), F.lit("2026-01-01").cast("timestamp")).select("doc_id", "issue")


@query("seller_evidence_recovery", b.with_adverts("""select doc_id, case doc_id % 12 when 10 then case when doc_id % 2 = 0 then 'Lancia' end else case when doc_id % 2 = 0 then 'Lancia' else m end end as make, doc_id % 2 = 0 and doc_id % 12 <> 10 as make_conflict from (select doc_id,
 case doc_id % 12 when 0 then 'Fiat' when 1 then 'Fiat' when 2 then 'BMW' when 3 then 'Mercedes-Benz' when 4 then 'Volkswagen' when 5 then 'Citroen' when 6 then 'Ford' when 7 then 'Audi' when 8 then 'Toyota' when 9 then 'Renault' when 11 then 'Fiat' end m from adverts)"""))
def seller_evidence_recovery(spark, d):
    none = F.lit(None)
    a = b.adverts(spark, d).select("doc_id", "title", "description", F.when(F.col("doc_id") % 2 == 0, "Lancia").alias("make"), none.cast("string").alias("model"), none.cast("bigint").alias("year"), none.cast("bigint").alias("mileage_km"), "fuel")
    out = mappers.recover_seller_evidence(a)
    return out.select("doc_id", "make", F.array_contains("seller_conflicts", "make").alias("make_conflict"))


@query("photo_sniffing", """select case page_id % 5 when 0 then 'image/jpeg' when 1 then 'image/png' when 2 then 'image/webp' else 'none' end as mime, case when page_id % 5 < 3 then 'fine' else 'invalid_image' end as issue, count(*) as n, cast(sum(octet_length(encode(html)) + case page_id % 5 when 0 then 5 when 1 then 16 when 2 then 12 else 0 end) as bigint) as bytes from pages group by 1, 2""")
def photo_sniffing(spark, d):
    body = F.col("html").cast("binary")
    size = F.octet_length(body)
    hexed = lambda t: F.unhex(F.lit(t))
    little = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(size + 4, s).bitwiseAND(255)), 2, "0")) for s in (0, 8, 16, 24)])
    k = F.col("page_id") % 5
    content = (
        F.when(k == 0, F.concat(hexed("FFD8FF"), body, hexed("FFD9"))).when(k == 1, F.concat(hexed("89504E470D0A1A0A"), body, hexed("49454E44AE426082")))
        .when(k == 2, F.concat(hexed("52494646"), little, hexed("57454250"), body)).otherwise(body)
    )
    out = photos.judge_photos(b.table(spark, d, "pages").select("page_id", content.alias("content")))
    return out.groupBy(F.coalesce("mime", F.lit("none")).alias("mime"), F.coalesce("issue", F.lit("fine")).alias("issue")).agg(F.count(F.lit(1)).alias("n"), F.sum("byte_count").alias("bytes"))


@query("event_sink_outcomes", b.with_asks("""select source, source_id, observed_at, content, arrivals, case when st is not null then case when st = content then 'repeated' else 'conflicting' end when content = fc then 'new' else 'conflicting' end as outcome from (
 select i.*, s.content as st, arg_min(i.content, i.pos) over (partition by i.source, i.source_id, i.observed_at) as fc from (select source, source_id, observed_at, cast(price_eur as string) as content, count(*) arrivals, min(struct_pack(a := version_key, b := cents)) pos from asks where version_key % 2 = 0 group by 1, 2, 3, 4) i
 left join (select source, source_id, observed_at, min(cast(price_eur as string)) as content from asks where version_key % 2 = 1 group by 1, 2, 3) s using (source, source_id, observed_at))"""))
def event_sink_outcomes(spark, d):
    a = b.asks(spark, d).withColumn("content", F.col("price_eur").cast("string"))
    stored = a.filter("version_key % 2 = 1").groupBy("source", "source_id", "observed_at").agg(F.min("content").alias("content"))
    return sinks.event_outcomes(a.filter("version_key % 2 = 0"), stored, "content", ["version_key", "cents"])


@query("append_only_sink", b.with_asks("select source, count(distinct (source_id, observed_at)) as events from asks group by 1"))
def append_only_sink(spark, d):
    a = b.asks(spark, d).withColumn("content", F.col("price_eur").cast("string"))
    path = shared_folder(spark, "events")
    schema = a.select("source", "source_id", "observed_at", "content").schema
    for part in ("version_key % 2 = 1", "version_key % 2 = 0"):
        stored = sinks.read_or_empty(spark, path, schema)
        sinks.append_new(sinks.new_events(a.filter(part), stored, "content", ["version_key", "cents"]), path)
    return spark.read.schema(schema).parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("events"))


@query("report_sink", "select o_orderstatus as run_id, count(*) as n, bool_and(o_custkey % 2 = 0) as first_write from orders where o_custkey % 2 = 0 and o_orderstatus <> 'P' or o_orderstatus = 'P' and o_custkey % 2 = 1 group by 1")
def report_sink(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderstatus").alias("run_id"), "o_orderkey", "o_custkey")
    path = shared_folder(spark, "reports")
    sinks.write_report(o.filter("o_custkey % 2 = 0 and run_id <> 'P'"), path)
    sinks.write_report(o.filter("o_custkey % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("o_custkey") % 2 == 0).alias("first_write"))
