"""Streaming ingestion, keyed state and change-driven rescoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import temporal
from ..session import cut_lineage, shared_folder
from ..streaming import incremental, ingest, state
from . import base as b
from .base import query


def _event_stream(spark, d):
    schema = b.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_latest_state", "select event_type as source, cast(user_id as string) as source_id, max(ts) as observed_at, count(*) as versions, arg_max(event_id, struct_pack(t := ts, e := event_id)) as event_id from events group by 1, 2")
def stream_latest_state(spark, d):
    events = _event_stream(spark, d).select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("observed_at"), "event_id")
    path, checkpoint = shared_folder(spark, "state"), shared_folder(spark, "state-log")
    state.run_to_end(state.latest_state(events, [], ties=("event_id",)), state.upsert_sink(path), checkpoint)
    return state.read_state(spark, path).select("source", "source_id", "observed_at", "versions", "event_id")


@query("stream_projection", "select event_type as source, cast(user_id as string) as source_id, ts as observed_at, cast(floor(value * 100) as bigint) as price_eur from (select *, row_number() over (partition by event_type, user_id, ts order by event_id) rn from events) where rn = 1")
def stream_projection(spark, d):
    events = _event_stream(spark, d).select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("observed_at"), "event_id", F.floor(F.col("value") * 100).cast("bigint").alias("price_eur"))
    path, checkpoint = shared_folder(spark, "projection"), shared_folder(spark, "projection-log")
    write = state.projection_writer(path, lambda df: df, ("source", "source_id", "observed_at"))
    state.run_to_end(events, write, checkpoint, mode="append")
    return spark.read.parquet(path + "/*").drop("batch", "event_id")


def _pages(spark, d):
    """Pages of at most 50 events: some records are foreign, priced as text or without a zone."""
    e = b.table(spark, d, "events")
    k = F.col("event_id")
    record = F.struct(
        F.concat(F.lit("u"), F.col("user_id")).alias("source_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(k % 13 == 0, "").otherwise("Z")).alias("observed_at"),
        F.lit("https://a.example/1").alias("url"), F.lit(True).alias("active"),
        F.concat(F.lit('{"country":"'), F.when(k % 29 == 0, "FR").otherwise("IT"), F.lit('","price_eur":'), F.when(k % 31 == 0, '"7"').otherwise("7"), F.lit("}")).alias("payload"),
    )
    page = F.floor(k / 50)
    # By event, so that a page collected again has the same records in the same order.
    rows = F.array_sort(F.collect_list(F.struct("event_id", "r")))
    pages = e.select("event_id", F.col("event_type").alias("source"), page.alias("page"), record.alias("r")).groupBy("source", "page").agg(rows["r"].alias("records"))
    cursor = F.concat(F.lit("c"), F.col("page").cast("string"))
    return pages.select(
        "source", F.lit("run").alias("run_id"), F.col("page").cast("string").alias("page_id"), F.lit("initial").alias("mode"), F.lit('{"country":"IT"}').alias("scope"),
        F.lag(cursor).over(Window.partitionBy("source").orderBy("page")).alias("input_cursor"), cursor.alias("next_cursor"), F.lit(False).alias("complete"), "records",
    )


_PAGE_SQL = """select event_type as source, count(distinct event_id // 50) as pages, count(*) filter (event_id % 13 <> 0 and event_id % 29 <> 0 and event_id % 31 <> 0) as accepted,
 count(*) filter (event_id % 13 = 0 or event_id % 29 = 0 or event_id % 31 = 0) as rejected from events group by 1"""

# Stored events are told apart by source, listing and time; what is refused is kept whole.
_STORED_SQL = _PAGE_SQL.replace("count(*) filter (event_id % 13 <> 0", "count(distinct (user_id, ts)) filter (event_id % 13 <> 0", 1)


def _ingested(spark, d, repeats=1):
    source, checkpoint = shared_folder(spark, "pages"), shared_folder(spark, "pages-log")
    store = ingest.PageStore(spark, shared_folder(spark, "store"))
    for _ in range(repeats):
        _pages(spark, d).write.mode("append").json(source)
        ingest.ingest_stream(spark, source, store, checkpoint, F.lit("2030-01-01").cast("timestamp")).awaitTermination()
    return store


@query("page_ingestion", _PAGE_SQL)
def page_ingestion(spark, d):
    m = _ingested(spark, d).manifest()
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


@query("page_ingestion_twice", _STORED_SQL)
def page_ingestion_twice(spark, d):
    """The same pages collected again change nothing."""
    store = _ingested(spark, d, repeats=2)
    pages = store.manifest().groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    good = store.events().groupBy("source").agg(F.count(F.lit(1)).alias("accepted"))
    bad = store.quarantine().groupBy("source").agg(F.count(F.lit(1)).alias("rejected"))
    return pages.join(good, "source").join(bad, "source")


@query("resume_state", "select event_type as source, 'run' as run_id, 'c' || cast(max(event_id // 50) as string) as next_cursor, 'continue' as action from events group by 1")
def resume_state(spark, d):
    return ingest.resume_state(_pages(spark, d)).select("source", "run_id", "next_cursor", "action")


@query("quarantine_replay", """with e as (select event_type as source, user_id, ts, event_id % 29 = 0 as abroad, event_id % 13 = 0 or event_id % 31 = 0 as odd from events), good as (select distinct source, user_id, ts from e where not abroad and not odd)
 select source, (select count(*) from (select distinct source, user_id, ts from e x where not abroad and odd and x.source = t.source and not exists (select 1 from good g where g.source = x.source and g.user_id = x.user_id and g.ts = x.ts))) as appended from (select distinct source from e) t""")
def quarantine_replay(spark, d):
    """What ingestion refused, under rules that read a time without zone as UTC and a price sent as text."""
    store = _ingested(spark, d)
    as_of = F.lit("2030-01-01").cast("timestamp")

    def newer_rules(refused):
        zoned = F.when(F.col("r.observed_at").rlike("Z$"), F.col("r.observed_at")).otherwise(F.concat("r.observed_at", F.lit("Z")))
        price = F.regexp_replace("r.payload", r'"price_eur":"(\d+)"', '"price_eur":$1')
        amended = F.col("r").withField("observed_at", zoned).withField("payload", price)
        return ingest.judge_records(ingest.read_back(refused).withColumn("r", amended), as_of)

    out = ingest.replay_quarantine(store.quarantine(), newer_rules, store.events())
    types = b.table(spark, d, "events").select(F.col("event_type").alias("source")).distinct()
    done = out.filter("outcome = 'new'").groupBy("source").agg(F.count(F.lit(1)).alias("appended"))
    return types.join(done, "source", "left").fillna(0, ["appended"])


EARLIER = "2001-04-30 00:00:00"
_FIELDS = ("source", "source_id", "observed_at", "price_eur", "year", "mileage_km")


def _signed(spark, d, moment):
    """Fresh listings at a moment with their own and their basis signature."""
    at = F.lit(moment).cast("timestamp")
    f = temporal.fresh(b.latest_asks(spark, d, at), at, b.WINDOW_DAYS)
    # Read as targets, as places and as cells.
    f = cut_lineage(f, "fresh")
    serves = F.col("price_kind") == "total"
    return incremental.near_basis_signatures(incremental.with_signature(f), f.filter(serves), _FIELDS, match=("source", "make", "model"), in_pool=serves)


def _at_sql(name: str, moment: str) -> str:
    own = "fuel, transmission, generation, trim, province, seller_type, condition, year, mileage_km, price_eur, price_kind, city, active, url"
    return f"""{name}_f as (select * exclude (rn) from (select *, row_number() over (partition by source, source_id order by observed_at desc, version_key desc, cents desc) rn from asks where observed_at <= timestamp '{moment}') where rn = 1 and active and observed_at >= timestamp '{moment}' - interval {b.WINDOW_DAYS} day),
 {name} as (select t.source, t.source_id, t.observed_at, t.price_eur, cast(row({own.replace(", ", ", t.").replace("fuel", "t.fuel", 1)}) as string) as sig, coalesce(pp.basis, '') as basis from {name}_f t left join (select t.source, t.source_id, string_agg(concat_ws('/', p.source_id, cast(p.observed_at as string), cast(p.price_eur as string), cast(p.year as string), cast(p.mileage_km as string)), ';' order by p.source_id) as basis
  from {name}_f t join {name}_f p on t.source = p.source and t.make = p.make and t.model = p.model and abs(t.year - p.year) <= 1 and abs(t.mileage_km - p.mileage_km) <= 20000 and t.source_id <> p.source_id where p.price_kind = 'total' group by 1, 2) pp using (source, source_id))"""


@query("change_driven_rescoring", b.with_asks("""select n.source, n.source_id, case when o.source is null then 'new' when o.sig <> n.sig then 'listing_changed' when o.basis <> n.basis then 'basis_changed' else 'unchanged' end as change from nw n left join ol o on o.source = n.source and o.source_id = n.source_id""", _at_sql("nw", b.AS_OF), _at_sql("ol", EARLIER)))
def change_driven_rescoring(spark, d):
    old = _signed(spark, d, EARLIER).select("source", "source_id", "signature", "basis_signature", F.lit(EARLIER).cast("timestamp").alias("as_of"), F.lit(1).alias("id"))
    return incremental.rescoring_plan(_signed(spark, d, b.AS_OF), old).select("source", "source_id", "change")


@query("visible_candidates", b.with_asks("""select o.source, o.source_id from ol o join nw n on o.source = n.source and o.source_id = n.source_id and o.observed_at = n.observed_at and o.sig = n.sig and o.basis = n.basis where o.price_eur < 9000""", _at_sql("nw", b.AS_OF), _at_sql("ol", EARLIER)))
def visible_candidates(spark, d):
    cheap = F.col("price_eur") < 9000
    old = _signed(spark, d, EARLIER).withColumns({"as_of": F.lit(EARLIER).cast("timestamp"), "id": F.lit(1), "selected": cheap})
    return incremental.visible_candidates(old, _signed(spark, d, b.AS_OF).withColumn("selected", cheap)).select("source", "source_id")
