"""Row checks, projections, filters and scalar maths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as doc, money, terms, text as tx, urls
from ..functions.damage import risky
from ..operators import predicates as P
from . import base as b
from .base import query

MARGIN_SQL = """(case when {p} <= 0 or {p} is null then null when {p} < 5000 then 2000 when {p} < 10000 then 3000 when {p} < 15000 then 4000
 else 5000 + 1000 * greatest(0, cast(ceil(({p} - 20000) / 5000) as bigint)) end)"""


def margin_sql(price: str) -> str:
    return MARGIN_SQL.format(p=price)


@query("parse_listings", b.with_asks(f"""select source, source_id, version_key, case
  when generation is null then 'generation is required' when fuel is null then 'fuel is required'
  when province is null then 'province is required' when seller_type is null then 'seller_type is required'
  when not (year between 1950 and 2002) then 'Invalid year' when mileage_km > 2000000 or price_eur not between 1 and 10000000 then 'Invalid mileage or EUR price'
  when observed_at > {b.AS_OF_SQL} then 'observed_at needs a time zone and cannot be in the future' end as issue from asks"""))
def parse_listings(spark, d):
    a = b.asks(spark, d)
    return a.withColumn("issue", P.listing_issue(a, b.as_of())).select("source", "source_id", "version_key", "issue")


@query("valid_listing_values", b.with_asks(f"""select source, source_id, version_key, make, model, fuel, transmission from asks where generation is not null and fuel is not null
  and observed_at <= {b.AS_OF_SQL} and price_eur >= 1"""))
def valid_listing_values(spark, d):
    valid, _ = P.parse_listings(b.asks(spark, d), b.as_of())
    return valid.select("source", "source_id", "version_key", "make", "model", "fuel", "transmission")


# Envelopes written as JSON text per event; some break one rule each.
_REC = """concat('{"source_id":"', cast(user_id as string), '","observed_at":"2024-01-01T00:00:00', case when event_id % 13 = 0 then '' else 'Z' end, '","url":"',
 case when event_id % 17 = 0 then 'ftp://x' else 'https://a.example/1' end, '"', case when event_id % 19 = 0 then ',"extra":1' else '' end, ',"active":',
 case when event_id % 23 = 0 then '"yes"' else 'true' end, ',"payload":{"country":"', case when event_id % 29 = 0 then 'fr' else 'it' end, '","price_eur":',
 case when event_id % 31 = 0 then '"10"' when event_id % 37 = 0 then '0' else '10' end, ',"price_kind":"', case when event_id % 41 = 0 then 'loan' else 'total' end, '"}}')"""


@query("event_envelope_checks", """select event_id, case when event_id % 19 = 0 then 'Invalid event envelope' when event_id % 13 = 0 then 'Timestamp needs timezone'
  when event_id % 17 = 0 then 'HTTP(S) URL required' when event_id % 23 = 0 then 'active must be boolean' when event_id % 29 = 0 then 'Only Italy is supported'
  when event_id % 31 = 0 or event_id % 37 = 0 then 'Price must be a positive integer in EUR' when event_id % 41 = 0 then 'Invalid price_kind' end as issue from events""")
def event_envelope_checks(spark, d):
    e = b.table(spark, d, "events").withColumn("text", F.expr(_REC)).withColumn("r", F.try_parse_json("text"))
    at, kind = (lambda p: doc.at("r", p)), (lambda p: doc.kind_of("r", p))
    issue = P.envelope_issue(
        F.json_object_keys("text"), at("source_id"), doc.instant(at("observed_at")), at("url"), kind("active"), kind("payload"), at("payload.country"),
        kind("payload.price_eur"), doc.at("r", "payload.price_eur", "bigint"), at("payload.price_kind"), doc.at("r", "payload.image_urls", "array<string>"),
        F.lit("2025-01-01").cast("timestamp"),
    )
    return e.select("event_id", issue.alias("issue"))


@query("compact_projection", b.with_asks("select source, source_id, observed_at, make, model, price_eur, year, mileage_km, fuel, city from asks"))
def compact_projection(spark, d):
    return P.compact_projection(b.asks(spark, d)).select("source", "source_id", "observed_at", "make", "model", "price_eur", "year", "mileage_km", "fuel", "city")


@query("nested_field_projection", """select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.k') is null as missing,
  case when event_id % 2 = 0 then cast(json_extract_string(props, '$.k') as bigint) end as deep from events""")
def nested_field_projection(spark, d):
    e = b.table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    nested = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"original":{"vehicle":{"rawData":[{"x":0},{"x":'), doc.at("v", "k"), F.lit("}]}}}")))
    return e.withColumn("n", F.try_parse_json(nested)).select(
        "event_id", doc.strict_int("v", "k").alias("k"), doc.at("v", "k").isNull().alias("missing"),
        doc.at("n", "original.vehicle.rawData.1.x", "bigint").alias("deep"),
    )


@query("strict_and_lenient_integers", """select event_id, case event_id % 4 when 0 then v end as strict_value, case when event_id % 4 in (0, 1) then v end as lenient_value
  from (select event_id, cast(floor(value * 100) as bigint) v from events)""")
def strict_and_lenient_integers(spark, d):
    cents = F.floor(F.col("value") * 100).cast("bigint").cast("string")
    text = (
        F.when(F.col("event_id") % 4 == 0, cents).when(F.col("event_id") % 4 == 1, F.concat(F.lit('"'), cents, F.lit('"')))
        .when(F.col("event_id") % 4 == 2, F.lit("true")).otherwise(F.concat(cents, F.lit(".5")))
    )
    e = b.table(spark, d, "events").withColumn("v", F.try_parse_json(F.concat(F.lit('{"p":'), text, F.lit("}"))))
    return e.select("event_id", doc.strict_int("v", "p").alias("strict_value"), doc.lenient_int("v", "p").alias("lenient_value"))


_PAY = r"(?:anticipo|acconto|rata|rate mensili)"
_EXP = r"(?:non\s+immatricolabil|esclusivamente\s+per\s+esportazione)"
_USABLE = f"""(price_eur > 0 and price_kind not in ('deposit', 'installment') and not (price_kind <> 'total' and regexp_matches(concat(title, ' ', description), '(?i){b.EDGE}{_PAY}{b.END}'))
  and not regexp_matches(concat(title, ' ', description), '(?i){b.EDGE}{_EXP}'))"""


@query("amount_usable", b.with_adverts(f"select doc_id, {_USABLE} as usable from adverts"))
def amount_usable(spark, d):
    a = b.adverts(spark, d)
    return a.select("doc_id", terms.amount_usable(F.col("price_eur"), F.col("price_kind"), tx.full_text("title", "description")).alias("usable"))


@query("wording_rules", b.with_adverts(rf"""select doc_id, regexp_matches(x, '{b.EDGE}{_EXP}') as restricted,
  regexp_matches(x, 'prezzo.{{0,40}}(?:solo con|con obbligo|vincolato|soggetto).{{0,25}}finanziament|finanziamento obbligatorio|prezzo.{{0,25}}con finanziament|iva\s*esclusa|\+\s*iva|(?:solo|per)\s*ricambi|fermo amministrativo|senza documenti') as conditional,
  regexp_matches(x, '(?:ritiriamo|compriamo|acquistiamo)\s+(?:le\s+)?auto\s+usate') and regexp_matches(x, '(?:qualsiasi tipo|se vuoi vendere|valutazioni|pagamento rapido)') as buying_service
  from (select doc_id, lower(concat(title, ' ', description)) x from adverts)"""))
def wording_rules(spark, d):
    a = b.adverts(spark, d)
    body = tx.full_text("title", "description")
    return a.select(
        "doc_id", terms.market_restricted(body).alias("restricted"), terms.conditional_price(body).alias("conditional"),
        terms.buying_service(F.col("description")).alias("buying_service"),
    )


_RISK = (
    r"incidentat\w*|sinistrat\w*|danneggiat\w*|grandin\w*|airbag.{0,15}(?:scoppi|esplos)|alluvionat\w*|incendiat\w*|uso ricambi|non marciante|"
    r"motore\s+(?:da\s+(?:cambiare|sostituire|rifare)|rotto|fuso)|(?:problemi|guasto|guasti)\s+(?:al\s+)?(?:motore|cambio)|carrozzeria\s+scolorita|crepa\s+sul\s+parafango"
)


@query("risky_listing", b.with_adverts(f"""select doc_id, condition = 'damaged' or damage_severity = 'severe' or {b.declared_sql("concat(title, ' ', description)", _RISK)} as risky from adverts"""))
def risky_listing(spark, d):
    a = b.adverts(spark, d)
    return a.select("doc_id", risky(a).alias("risky"))


@query("identity_present", b.with_asks("select source, source_id, version_key, year between 1980 and 2030 and mileage_km between 0 and 1000000 as present from asks"))
def identity_present(spark, d):
    return b.asks(spark, d).select("source", "source_id", "version_key", P.identity_present().alias("present"))


_DIST = """6371.0088 * 2 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(latitude - 41.9) / 2), 2) + cos(radians(41.9)) * cos(radians(latitude)) * pow(sin(radians(longitude - 12.5) / 2), 2)))))"""


@query("catalogue_search_radius", b.with_asks(f"""select source, source_id, observed_at, price_eur, cast(round(dist) as bigint) as distance_km from (select *, {_DIST} as dist from latest where active and price_kind = 'total'
  and price_eur between 2000 and 15000) where dist <= 600 order by observed_at desc, source, source_id limit 100 offset 50"""))
def catalogue_search_radius(spark, d):
    out = P.catalogue_search(
        b.asks(spark, d), min_price=2000, max_price=15_000, latitude=41.9, longitude=12.5, radius_km=600, offset=50, ties=b.TIES, as_of=b.as_of()
    )
    return out.select("source", "source_id", "observed_at", "price_eur", F.round("distance_km").cast("bigint").alias("distance_km"))


@query("catalogue_search_province", b.with_asks("""select source, source_id, observed_at, price_eur from latest where active and price_kind = 'total' and price_eur between 1000 and 50000
  and province = 'nation_3' order by observed_at desc, source, source_id limit 100"""))
def catalogue_search_province(spark, d):
    return P.catalogue_search(b.asks(spark, d), province="NATION_3", ties=b.TIES, as_of=b.as_of()).select("source", "source_id", "observed_at", "price_eur")


@query("filter_cards", b.with_asks("select source, source_id, price_eur from fresh where make = 'brand#7' and price_eur >= 3000 and price_eur <= 12000 and mileage_km <= 150000 and fuel = '1-urgent'"))
def filter_cards(spark, d):
    f = b.fresh(spark, d)
    return P.filter_cards(f, {"make": "brand#7", "min_price_eur": 3000, "max_price_eur": 12_000, "max_mileage_km": 150_000, "fuel": "1-urgent"}).select(
        "source", "source_id", "price_eur"
    )


@query("field_gaps", b.with_asks("""select source, source_id, version_key, array_to_string(list_filter([case when generation is null then 'generation' end, case when fuel is null then 'fuel' end,
  case when version_text is null then 'version_text' end, case when price_kind <> 'total' then 'total_asking_price' end, case when condition = 'unknown' then 'condition' end], lambda x: x is not null), ',') as missing from asks"""))
def field_gaps(spark, d):
    a = b.asks(spark, d)
    missing = P.missing_fields(("make", "model", "generation", "fuel", "version_text", "year"), a)
    return a.select("source", "source_id", "version_key", F.array_join(missing, ",").alias("missing"))


@query("refresh_decision", b.with_asks(f"""select i.source, i.source_id, case when k.source is null then 'screen_new' when k.price_eur = i.price_eur and k.mileage_km = i.mileage_km and k.year = i.year
  and k.version_text is not distinct from i.version_text and k.observed_at > {b.AS_OF_SQL} - interval 7 day then case when k.detail_fetched then 'skip_known' else 'rescreen_for_details' end else 'screen_changed' end as decision
  from latest i left join (select * from (select *, row_number() over (partition by source, source_id order by observed_at desc, version_key desc, cents desc) rn from asks where observed_at <= {b.AS_OF_SQL} and version_key % 5 <> 0) where rn = 1) k using (source, source_id)"""))
def refresh_decision(spark, d):
    from ..operators.temporal import latest_as_of

    known = latest_as_of(b.asks(spark, d).filter("version_key % 5 <> 0"), b.as_of(), ties=b.TIES)
    return P.refresh_decision(b.latest(spark, d), known, b.as_of()).select("source", "source_id", "decision")


@query("enrichment_todo", b.with_asks("""select source, source_id, observed_at from fresh f where (fuel is null or condition = 'unknown' or price_kind <> 'total')
  and not exists (select 1 from asks q where q.source = f.source and q.source_id = f.source_id and q.observed_at = f.observed_at and q.mileage_km > 150000)
  order by observed_at desc, source, source_id limit 100"""))
def enrichment_todo(spark, d):
    rows = b.latest(spark, d).withColumn("issue", F.when(F.col("fuel").isNull(), "fuel is required"))
    return P.enrichment_todo(rows, b.asks(spark, d).filter("mileage_km > 150000"), b.as_of(), 100, b.WINDOW_DAYS).select("source", "source_id", "observed_at")


@query("purchase_exclusion_reasons", b.with_asks(f"""select reason, count(*) as n from (select case when {_USABLE.replace("regexp_matches(concat(title, ' ', description), '(?i)" + b.EDGE + _EXP + "')", "false")} is false
   or regexp_matches(description, 'non immatricolabile') then 'missing_basic_identity_or_total_price' when price_eur not between 1000 and 20000 then 'purchase_outside_test_range'
   when {b.declared_sql("concat(title, ' ', description)", r"airbag.{0,24}esplos\w*|motore\s+(?:rotto|fuso)|danni?\s+struttural\w*|uso\s+ricambi")} then 'known_severe_damage' end as reason from fresh) where reason is not null group by reason"""))
def purchase_exclusion_reasons(spark, d):
    from ..functions.damage import with_damage
    from ..operators.quality import reason_counts

    f = with_damage(b.fresh(spark, d)).withColumn("body", tx.full_text("title", "description"))
    return reason_counts(f.withColumn("reason", P.discovery_exclusion()), "reason")


@query("margin_and_budget", b.with_asks(f"""select source, source_id, {margin_sql('price_eur')} as required, least(3, price_eur // 5000) as price_band,
  (price_eur * 2 * 85) // 100 - price_eur - 750 - {margin_sql('price_eur')} as budget from fresh where price_eur > 0"""))
def margin_and_budget(spark, d):
    f = b.fresh(spark, d).filter("price_eur > 0")
    budget = money.feasibility(F.col("price_eur"), F.col("price_eur") * 2, F.lit("low"))
    return f.select(
        "source", "source_id", money.required_margin("price_eur").alias("required"), money.price_band("price_eur").cast("bigint").alias("price_band"),
        budget["remaining_cost_budget_eur"].alias("budget"),
    )


@query("peer_weights", f"""select o_orderkey, cast(floor(1.0 / (1.0 + abs(year(o_orderdate) - 1998) + abs(o_orderkey % 40000 - 20000) / 20000.0 + (epoch_us({b.AS_OF_SQL}) - epoch_us(o_orderdate)) / 86400000000.0 / 30.0) * 1e9 + 0.5) as bigint) as w
  from orders where o_orderdate <= {b.AS_OF_SQL}""")
def peer_weights(spark, d):
    o = b.table(spark, d, "orders").filter(F.col("o_orderdate") <= b.as_of())
    w = money.peer_weight_nano(
        F.abs(F.year("o_orderdate") - 1998), F.abs(F.col("o_orderkey") % 40_000 - 20_000), money.age_days(b.as_of(), "o_orderdate")
    )
    return o.select("o_orderkey", w.alias("w"))


_HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"


@query("url_rules", f"""select page_id, regexp_matches(url, '^https?://[^/]+') as http_ok, regexp_matches(url, '^https://') and {_HOST} like '%.%' as public_ok, {_HOST} as host,
  {_HOST} = 'example.org' or {_HOST} like '%.example.org' as within_org from pages""")
def url_rules(spark, d):
    return b.table(spark, d, "pages").select(
        "page_id", urls.http_url("url").alias("http_ok"), urls.public_https("url").alias("public_ok"), urls.host("url").alias("host"),
        urls.host_within("url", ("example.org",)).alias("within_org"),
    )


@query("age_and_periods", f"""select o_orderkey, cast(floor((epoch_us({b.AS_OF_SQL}) - epoch_us(o_orderdate)) / 86400000000.0) as bigint) as age_days, date_trunc('month', o_orderdate)::date as month_start,
  o_orderdate between {b.AS_OF_SQL} - interval 30 day and {b.AS_OF_SQL} as in_window from orders""")
def age_and_periods(spark, d):
    start = b.as_of() - F.expr("interval 30 days")
    return b.table(spark, d, "orders").select(
        "o_orderkey", F.floor(money.age_days(b.as_of(), "o_orderdate")).cast("bigint").alias("age_days"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("month_start"), F.col("o_orderdate").between(start, b.as_of()).alias("in_window"),
    )


@query("registration_year", """select event_id, case when event_id % 3 < 2 then case when y between 1950 and 2002 then y end end as year from (select event_id, 1940 + event_id % 80 as y from events)""")
def registration_year(spark, d):
    y = (F.col("event_id") % 80 + 1940).cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("05-"), y)).when(F.col("event_id") % 3 == 1, F.concat(y, F.lit("-05-31"))).otherwise(y)
    text = F.concat(F.regexp_extract(raw, r"^\d{2}-(\d{4})$", 1), F.regexp_extract(raw, r"^(\d{4})-\d{2}-\d{2}$", 1)).try_cast("bigint")
    return b.table(spark, d, "events").select("event_id", F.when(text.between(F.lit(1950), F.year(b.as_of()) + 1), text).alias("year"))


@query("canonical_signature", b.with_asks("""select source, source_id, count(*) as versions, count(distinct concat_ws('|', coalesce(fuel, ''), cast(year as string), cast(mileage_km as string), cast(price_eur as string), price_kind)) as distinct_contents
  from asks group by source, source_id"""))
def canonical_signature(spark, d):
    a = b.asks(spark, d).withColumn("sig", doc.signature("fuel", "year", "mileage_km", "price_eur", "price_kind"))
    return a.groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("sig").alias("distinct_contents"))


@query("alias_reconciliation", """select o_orderkey, case when o_orderkey % 5 <> 0 or o_orderkey % 3 = 0 then lower(o_orderstatus) end as status, o_orderkey % 5 = 0 and o_orderkey % 3 <> 0 as status_conflict from orders""")
def alias_reconciliation(spark, d):
    from ..operators.evidence import reconcile_aliases

    o = b.table(spark, d, "orders").withColumn("stato", F.when(F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderstatus")).otherwise(F.lit("?"))))
    out = reconcile_aliases({"status": ("o_orderstatus", "stato")})
    return o.select("o_orderkey", F.lower(out["status"]).alias("status"), out["status_conflict"].alias("status_conflict"))


@query("hp_kw_consistency", """select p_partkey, abs(60 + p_size - (45 + p_partkey % 10) * 1.35962) > 2 as conflict from part""")
def hp_kw_consistency(spark, d):
    return b.table(spark, d, "part").select("p_partkey", money.hp_kw_conflict(F.col("p_size") + 60, F.col("p_partkey") % 10 + 45).alias("conflict"))


@query("blocker_lists", b.with_asks("""select source, source_id, array_to_string(list_filter([case when fuel is null then 'fuel' end, case when generation is null then 'generation' end,
  case when condition = 'damaged' then 'condition' end], lambda x: x is not null), '|') as blockers, fuel is null and generation is null as both_gaps from fresh"""))
def blocker_lists(spark, d):
    f = b.fresh(spark, d)
    blockers = tx.labels(fuel=F.col("fuel").isNull(), generation=F.col("generation").isNull(), condition=F.col("condition") == "damaged")
    from ..operators.dedup import covers

    return f.select("source", "source_id", F.array_join(blockers, "|").alias("blockers"), covers(F.array(F.lit("fuel"), F.lit("generation")), blockers).alias("both_gaps"))


