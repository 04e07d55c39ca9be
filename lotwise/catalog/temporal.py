"""Versions in time: latest, changes, history, chains, splits and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, ordered, quality, temporal
from . import base as b
from .base import query

KEY_COLS = "source, source_id"


@query("latest_as_of", b.with_asks("select source, source_id, observed_at, price_eur, active, version_key from latest"))
def latest_as_of(spark, d):
    return b.latest(spark, d).select("source", "source_id", "observed_at", "price_eur", "active", "version_key")


@query("fresh_active", b.with_asks("select source, source_id, observed_at, price_kind, price_eur from fresh"))
def fresh_active(spark, d):
    return b.fresh(spark, d).select("source", "source_id", "observed_at", "price_kind", "price_eur")


@query("event_latest_state", """
select event_type, user_id, max(ts) as ts, count(*) as versions, arg_max(event_id, struct_pack(t := ts, e := event_id)) as event_id
from events group by event_type, user_id""")
def event_latest_state(spark, d):
    ev = b.table(spark, d, "events")
    order = F.struct("ts", "event_id")
    return ev.groupBy("event_type", "user_id").agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("versions"), F.max_by("event_id", order).alias("event_id")
    )


REVIEWS_SQL = """reviews as (select source, source_id, observed_at as as_of, version_key as id, price_eur % 3 = 0 as selected,
  price_eur from asks where price_kind = 'total')"""


@query("latest_review", b.with_asks("""select source, source_id, as_of, id, selected from (
  select *, row_number() over (partition by source, source_id order by as_of desc, id desc) rn from reviews) where rn = 1""", REVIEWS_SQL))
def latest_review(spark, d):
    from ..streaming.incremental import latest_reviews

    a = b.asks(spark, d).filter("price_kind = 'total'")
    reviews = a.select("source", "source_id", F.col("observed_at").alias("as_of"), F.col("version_key").alias("id"), (F.col("price_eur") % 3 == 0).alias("selected"))
    return latest_reviews(reviews)


@query("price_changes", b.with_asks("""select source, source_id, observed_at, pp as previous_price_eur, price_eur, price_eur - pp as delta_eur from (
  select *, lag(price_eur) over w as pp, lag(price_kind) over w as pk from asks window w as (partition by source, source_id order by observed_at, version_key, cents))
  where pk = 'total' and price_kind = 'total' and pp <> price_eur"""))
def price_changes(spark, d):
    return temporal.price_changes(b.asks(spark, d), b.TIES)


@query("event_value_changes", """select event_type as source, cast(user_id as string) as source_id, ts as observed_at, pv as previous_price_eur, v as price_eur, v - pv as delta_eur from (
  select *, lag(v) over (partition by event_type, user_id order by ts, event_id) pv from (select *, cast(floor(value * 100) as bigint) v from events)) where pv <> v""")
def event_value_changes(spark, d):
    ev = b.table(spark, d, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("source_id"), F.col("ts").alias("observed_at"), "event_id",
        F.floor(F.col("value") * 100).cast("bigint").alias("price_eur"), F.lit("total").alias("price_kind"),
    )
    return temporal.price_changes(ev, ("event_id",))


@query("history_window", """select event_type, user_id, event_id, rn as newest_rank, n as observation_count, n > 20 as history_truncated from (
  select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) rn, count(*) over (partition by event_type, user_id) n from events) where rn <= 20""")
def history_window(spark, d):
    ev = b.table(spark, d, "events").withColumnRenamed("ts", "observed_at")
    out = temporal.recent_history(ev, ("event_id",), window=20, keys=("event_type", "user_id"))
    return out.select("event_type", "user_id", "event_id", F.col("newest_rank").cast("bigint").alias("newest_rank"), "observation_count", "history_truncated")


# Pages: a run per event type, a page per day, cursors by day number; some chains are broken on purpose.
_PAGES = """pages_m as (select event_type as source, 'run' as run_id, cast(dense_rank() over (partition by event_type order by d) as bigint) as sequence,
  d, n, rej, max(d) over (partition by event_type) as last_d from (select event_type, cast(floor(epoch(ts) / 86400) as bigint) d, count(*) n,
  count_if(value < 5) rej from events group by 1, 2)),
 manifest as (select source, run_id, sequence, case when sequence = 1 then null when d % 7 = 0 then concat('x', cast(d as string)) else concat('c', cast(sequence - 1 as string)) end as input_cursor,
  case when d = last_d then null else concat('c', cast(sequence as string)) end as next_cursor, d = last_d as complete,
  'initial' as mode, case when d % 11 = 0 then 'other' else 'IT' end as scope, n - rej as accepted, rej as rejected from pages_m)"""


def _manifest(spark, d):
    from pyspark.sql import Window

    day = F.unix_date(F.to_date("ts")).cast("bigint")
    per_day = b.table(spark, d, "events").groupBy(F.col("event_type").alias("source"), day.alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 5).alias("rej")
    )
    w = Window.partitionBy("source")
    p = per_day.withColumn("sequence", F.dense_rank().over(w.orderBy("d")).cast("bigint")).withColumn("last", F.max("d").over(w))
    seq = F.col("sequence")
    return p.select(
        "source", F.lit("run").alias("run_id"), "sequence",
        F.when(seq == 1, F.lit(None)).when(F.col("d") % 7 == 0, F.concat(F.lit("x"), F.col("d"))).otherwise(F.concat(F.lit("c"), seq - 1)).alias("input_cursor"),
        F.when(F.col("d") != F.col("last"), F.concat(F.lit("c"), seq)).alias("next_cursor"), (F.col("d") == F.col("last")).alias("complete"),
        F.lit("initial").alias("mode"), F.when(F.col("d") % 11 == 0, "other").otherwise("IT").alias("scope"),
        (F.col("n") - F.col("rej")).alias("accepted"), F.col("rej").alias("rejected"),
    )


@query("page_chain_check", f"""with {_PAGES}, l as (select *, lag(next_cursor) over w pn, lag(scope) over w ps, lag(complete) over w pc from manifest window w as (partition by source, run_id order by sequence))
select source, run_id, sequence, case when sequence = 1 then (case when input_cursor is not null then 'first_page_has_cursor' end)
  when pc then 'page_after_completion' when ps <> scope then 'configuration_changed' when input_cursor is distinct from pn then 'cursor_not_continued' end as issue from l""")
def page_chain_check(spark, d):
    return temporal.page_chain_issues(_manifest(spark, d)).select("source", "run_id", "sequence", "issue")


@query("run_status", f"""with {_PAGES} select source, run_id, arg_max(mode, sequence) as mode, max(case when next_cursor is null then null else next_cursor end) filter (sequence = m) as next_cursor,
  bool_or(complete) filter (sequence = m) as complete, count(*) as pages, cast(sum(accepted) as bigint) as accepted, cast(sum(rejected) as bigint) as quarantined
  from (select *, max(sequence) over (partition by source, run_id) m from manifest) group by source, run_id""")
def run_status(spark, d):
    return temporal.run_status(_manifest(spark, d))


@query("latest_attempt", """select conv_id, turn, role, length(text) as chars from (select *, row_number() over (partition by conv_id order by turn desc) rn from conversations) where rn = 1""")
def latest_attempt(spark, d):
    c = b.table(spark, d, "conversations")
    return temporal.pick_first(c, ["conv_id"], [F.col("turn").desc()]).select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"))


@query("holdout_split", b.with_asks("""select source, source_id, make, model, (rn - 1) % 5 = 0 as held_out from (
  select *, row_number() over (partition by make, model order by sha256(concat('(''', source, ''', ''', source_id, ''')'))) rn from fresh)"""))
def holdout_split(spark, d):
    return temporal.holdout_split(b.fresh(spark, d), ["make", "model"]).select("source", "source_id", "make", "model", "held_out")


@query("ranked_within_band", b.with_asks("""select price_band, source, source_id, rn as band_rank from (select *, row_number() over (partition by price_band order by price_eur desc, source, source_id) rn
  from (select *, least(3, price_eur // 5000) as price_band from fresh))"""))
def ranked_within_band(spark, d):
    from ..functions.money import price_band

    f = b.fresh(spark, d).withColumn("price_band", price_band("price_eur").cast("bigint"))
    out = ordered.ranked(f.select("price_band", "price_eur", "source", "source_id"), ["price_band"], [F.col("price_eur").desc(), F.col("source"), F.col("source_id")], "band_rank")
    return out.select("price_band", "source", "source_id", "band_rank")


@query("first_per_identity", b.with_asks("""select year, mileage_km, price_eur, city, version_text, source, source_id from (
  select *, row_number() over (partition by year, mileage_km, price_eur, city, version_text order by source, source_id) rn from fresh) where rn = 1"""))
def first_per_identity(spark, d):
    return dedup.collapse_reposts(b.fresh(spark, d), "third_party").select("year", "mileage_km", "price_eur", "city", "version_text", "source", "source_id")


@query("cumulative_weight", """select l_returnflag, price, w, sum(w) over (partition by l_returnflag order by price rows unbounded preceding) as cum_w from (
  select l_returnflag, cast(floor(l_extendedprice / 100) as bigint) price, cast(sum(cast(l_quantity as bigint)) as bigint) w from lineitem group by 1, 2)""")
def cumulative_weight(spark, d):
    from ..operators.stats import price_ladder

    li = b.table(spark, d, "lineitem").withColumn("price", F.floor(F.col("l_extendedprice") / 100).cast("bigint"))
    return price_ladder(li, ["l_returnflag"], "price", F.col("l_quantity").cast("bigint")).select("l_returnflag", "price", "w", "cum_w")


@query("evenly_spaced_sample", b.with_asks("""select make, source, source_id, price_eur, i as sample_rank from (
  select *, row_number() over (partition by make order by price_eur, source, source_id) - 1 as i, count(*) over (partition by make) as n from fresh) t
  where n <= 50 or exists (select 1 from range(50) r(s) where cast(round_even(r.s * (n - 1) / 49.0, 0) as bigint) = i)"""))
def evenly_spaced_sample(spark, d):
    out = temporal.evenly_spaced(b.fresh(spark, d), ["make"], [F.col("price_eur"), F.col("source"), F.col("source_id")])
    return out.select("make", "source", "source_id", "price_eur", F.col("sample_rank").cast("bigint").alias("sample_rank"))


@query("not_yet_projected", b.with_asks("""select source, source_id, observed_at from asks a where not exists (
  select 1 from asks p where p.source = a.source and p.source_id = a.source_id and p.observed_at = a.observed_at and p.version_key % 3 = 0)"""))
def not_yet_projected(spark, d):
    a = b.asks(spark, d)
    return temporal.not_yet_projected(a, a.filter("version_key % 3 = 0")).select("source", "source_id", "observed_at")


@query("cached_facts_join", b.with_asks("""select f.source, f.source_id, c.fact from fresh f left join (select source, source_id, max(mileage_km) as fact from asks where version_key % 4 = 0 group by 1, 2) c
  using (source, source_id) where f.source <> 'a' or c.fact is not null"""))
def cached_facts_join(spark, d):
    a = b.asks(spark, d)
    facts = a.filter("version_key % 4 = 0").groupBy("source", "source_id").agg(F.max("mileage_km").alias("fact"))
    return temporal.with_cached_facts(b.fresh(spark, d), facts, ["source", "source_id"], "a").select("source", "source_id", "fact")


@query("last_key_of_page", """select l_shipdate as page, max(struct_pack(a := l_orderkey, b := l_partkey, c := l_linenumber)).a as last_order,
  max(struct_pack(a := l_orderkey, b := l_partkey, c := l_linenumber)).b as last_part from lineitem group by l_shipdate""")
def last_key_of_page(spark, d):
    top = F.max(F.struct("l_orderkey", "l_partkey", "l_linenumber"))
    return b.table(spark, d, "lineitem").groupBy(F.col("l_shipdate").alias("page")).agg(top.alias("k")).select(
        "page", F.col("k.l_orderkey").alias("last_order"), F.col("k.l_partkey").alias("last_part")
    )


@query("revision_fingerprint", """select l_returnflag as source, count(*) as events, max(l_shipdate) as max_observed_at,
  sha256(concat(cast(count(*) as string), '|', strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S.%f'))) as fingerprint from lineitem group by 1""")
def revision_fingerprint(spark, d):
    li = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("observed_at"))
    return quality.revision_fingerprint(li, ["source"])


@query("revision_gate", """with f as (select l_returnflag s, count(*) n, max(l_shipdate) m from lineitem group by 1),
 p as (select l_returnflag s, count(*) n, max(l_shipdate) m from lineitem where l_returnflag <> 'R' or l_linenumber < 7 group by 1)
 select f.s as source, f.n = p.n and f.m = p.m as skip from f left join p using (s)""")
def revision_gate(spark, d):
    li = b.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("observed_at"), "l_linenumber")
    saved = quality.revision_fingerprint(li.filter("source <> 'R' or l_linenumber < 7"), ["source"])
    return quality.unchanged_since(quality.revision_fingerprint(li, ["source"]), saved, ["source"]).select("source", "skip")
