"""Page ingestion as micro-batches: idempotent pages, quarantine and a trusted manifest."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import documents as doc
from ..operators.predicates import envelope_issue
from ..schema import PAGE_SCHEMA
from ..session import cut_lineage
from ..sources.sinks import event_outcomes, read_or_empty
from .chains import PAGE, continue_runs, run_tails

# Limits of a page.
MAX_PAGE_RECORDS = 5000
MAX_IDENTIFIER = 200
MAX_CURSOR = 4000
MAX_PAGE_BYTES = 20_000_000

EVENTS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("observed_at", T.TimestampType()),
    T.StructField("url", T.StringType()), T.StructField("active", T.BooleanType()), T.StructField("payload", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("batch", T.LongType()),
])
QUARANTINE = T.StructType([
    T.StructField(n, T.StringType()) for n in ("source", "run_id", "page_id")
] + [T.StructField("ordinal", T.IntegerType()), T.StructField("payload", T.StringType()), T.StructField("issue", T.StringType()), T.StructField("batch", T.LongType())])
MANIFEST = T.StructType([
    T.StructField(n, T.StringType()) for n in ("source", "run_id", "page_id", "checksum", "mode", "scope", "input_cursor", "next_cursor")
] + [T.StructField("complete", T.BooleanType()), T.StructField("sequence", T.LongType()), T.StructField("accepted", T.LongType()), T.StructField("rejected", T.LongType()), T.StructField("batch", T.LongType())])

DONE = T.StructType([T.StructField("batch", T.LongType())])


@dataclass(frozen=True)
class PageStore:
    """Folder with the events, the quarantine, the page manifest and the batches that are done.

    Every micro-batch writes its own sub-folders and its name last. Readers keep only rows of
    batches that are named, so a batch that died half way is invisible, and replaying it
    overwrites the same folders. A batch of which every page was refused is done as well.
    """

    spark: SparkSession
    root: str

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        return read_or_empty(self.spark, os.path.join(self.root, name, "*"), schema)

    def _committed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._table("done", DONE).distinct(), "batch", "left_semi")

    def manifest(self) -> DataFrame:
        return self._committed(self._table("manifest", MANIFEST))

    def events(self) -> DataFrame:
        return self._committed(self._table("events", EVENTS))

    def quarantine(self) -> DataFrame:
        return self._committed(self._table("quarantine", QUARANTINE))

    def save(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(os.path.join(self.root, name, f"b{batch}"))


def page_issue(known: Column) -> Column:
    """First structural rule a page breaks; ``known`` is its stored checksum or NULL."""
    scope = F.try_parse_json("scope")
    named = [F.coalesce(F.trim(c) == "", F.lit(True)) | (F.length(c) > MAX_IDENTIFIER) for c in ("source", "run_id", "page_id")]
    odd_cursor = [F.coalesce((F.col(c) == "") | (F.length(c) > MAX_CURSOR), F.lit(False)) for c in ("input_cursor", "next_cursor")]
    return F.coalesce(
        F.when(named[0] | named[1] | named[2], F.lit("identifiers require text of at most 200 characters")),
        F.when(odd_cursor[0] | odd_cursor[1], F.lit("cursor must be a nonempty text or null")),
        F.when(F.col("bytes") > MAX_PAGE_BYTES, F.lit("page exceeds 20 MB")),
        F.when(known.isNotNull() & (known != F.col("checksum")), F.lit("page id already used with different content")),
        F.when(~F.col("mode").isin("initial", "incremental") | F.col("mode").isNull(), F.lit("mode must be initial or incremental")),
        F.when(~doc.at(scope, "country").eqNullSafe(F.lit("IT")), F.lit("scope must state country IT")),
        F.when(F.col("complete").isNull() | (F.col("complete") != F.col("next_cursor").isNull()), F.lit("completion and cursor disagree")),
        F.when(F.size("records") > MAX_PAGE_RECORDS, F.lit("too many records")),
        F.when(~F.col("complete") & F.col("next_cursor").eqNullSafe(F.col("input_cursor")), F.lit("cursor did not advance")),
    )


def explode_records(pages: DataFrame, as_of: Column) -> DataFrame:
    """One row per record with its typed envelope and first issue."""
    return judge_records(pages.select("source", "run_id", "page_id", F.posexplode("records").alias("ordinal", "r")), as_of)


def judge_records(records: DataFrame, as_of: Column) -> DataFrame:
    """Records ``r`` with their typed envelope, first issue and the original as text."""
    d = records
    payload = F.try_parse_json("r.payload")
    d = d.select(
        "source", "run_id", "page_id", "ordinal", F.trim("r.source_id").alias("source_id"), doc.instant("r.observed_at").alias("observed_at"),
        F.col("r.url").alias("url"), F.coalesce("r.active", F.lit(True)).alias("active"), F.col("r.payload").alias("payload"), F.to_json("r").alias("record"), payload.alias("_p"),
    )
    issue = envelope_issue(
        F.array(*[F.lit(k) for k in ("source_id", "observed_at", "url", "active", "payload")]),
        F.col("source_id"), F.col("observed_at"), F.col("url"), F.lit("BOOLEAN"), F.schema_of_variant("_p"),
        doc.at("_p", "country"), doc.kind_of("_p", "price_eur"), doc.at("_p", "price_eur", "bigint"), doc.at("_p", "price_kind"),
        doc.at("_p", "image_urls", "array<string>"), as_of,
    )
    content = F.to_json(F.struct("url", "active", "payload"))
    return d.withColumn("issue", issue).withColumn("content", content).drop("_p")


def read_back(quarantined: DataFrame) -> DataFrame:
    """Refused records as they were sent; pages refused whole are left out."""
    record = PAGE_SCHEMA["records"].dataType.elementType
    return quarantined.filter("ordinal >= 0").select("source", "run_id", "page_id", "ordinal", F.from_json("payload", record).alias("r"))


def ingest_batch(store: PageStore, pages: DataFrame, batch: int, as_of: Column) -> None:
    """Accept one micro-batch of pages: sound ones that continue their run, in any order within the batch.

    Others go to the quarantine whole, with their reason. A page already stored is passed over.
    """
    known = store.manifest().filter(F.col("batch") != batch).groupBy("source", "run_id", "page_id").agg(F.min("checksum").alias("_known"))
    text = F.to_json(F.struct(*sorted(pages.columns)))
    sent = pages.withColumn("checksum", F.sha2(text, 256)).withColumn("bytes", F.octet_length(text))
    sent = sent.dropDuplicates(["source", "run_id", "page_id", "checksum"]).join(known, ["source", "run_id", "page_id"], "left")
    # Of two contents for one page in a batch, that of the least checksum holds; the other is refused like one that comes later.
    first = F.min("checksum").over(Window.partitionBy("source", "run_id", "page_id"))
    judged = sent.withColumn("page_issue", page_issue(F.coalesce("_known", first)))
    # What decides is small beside the records: it is written once, ranked, and joined to them again.
    facts = cut_lineage(judged.filter(F.col("page_issue").isNotNull() | F.col("_known").isNull()).withColumn("_n", F.size("records").cast("bigint")).drop("records", "_known", "bytes"), "pages")
    tails = run_tails(store.manifest().filter(F.col("batch") != batch))
    chained = cut_lineage(continue_runs(facts.filter("page_issue is null").drop("page_issue"), tails), "chained")
    accepted = chained.filter("sequence is not null")
    fresh = sent.join(accepted.select(*PAGE), list(PAGE), "left_semi")
    records = explode_records(fresh, as_of)
    stored = store.events().filter(F.col("batch") != batch)
    outcomes = event_outcomes(
        records.filter(F.col("issue").isNull()), stored, "content", ["run_id", "page_id", "ordinal"], carry=["url", "active", "payload", "record", "run_id", "page_id", "ordinal"]
    )
    store.save("events", outcomes.filter("outcome = 'new'").select(*[f for f in EVENTS.fieldNames() if f != "batch"]), batch)
    bad = records.filter(F.col("issue").isNotNull()).select("source", "run_id", "page_id", "ordinal", F.col("record").alias("payload"), "issue")
    clash = outcomes.filter("outcome = 'conflicting'").select("source", "run_id", "page_id", "ordinal", F.col("record").alias("payload"), F.lit("Conflicting immutable event").alias("issue"))
    refusals = facts.filter("page_issue is not null").select(*PAGE, F.col("page_issue").alias("issue")).unionByName(chained.filter("sequence is null").select(*PAGE, F.col("chain_issue").alias("issue")))
    broken = sent.join(refusals, list(PAGE)).select("source", "run_id", "page_id", F.lit(-1).alias("ordinal"), F.to_json("records").alias("payload"), "issue")
    rejected = bad.unionByName(clash)
    store.save("quarantine", rejected.unionByName(broken), batch)
    # Counts come from what was just written, so the inputs are evaluated once.
    written = store._table("quarantine", QUARANTINE).filter((F.col("batch") == batch) & (F.col("ordinal") >= 0))
    refused = written.groupBy("source", "run_id", "page_id").agg(F.count(F.lit(1)).alias("rejected"))
    manifest = accepted.join(refused, ["source", "run_id", "page_id"], "left").fillna(0, ["rejected"])
    store.save("manifest", manifest.withColumn("accepted", F.col("_n") - F.col("rejected")).select(*[f for f in MANIFEST.fieldNames() if f != "batch"]), batch)
    store.save("done", store.spark.range(1).select(), batch)


def ingest_stream(spark: SparkSession, pages_path: str, store: PageStore, checkpoint: str, as_of: Column, max_files: int = 1000) -> StreamingQuery:
    """Follow a folder of page files; the checkpoint makes a stopped collection resume."""
    pages = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).json(pages_path)
    return (
        pages.writeStream.foreachBatch(lambda df, n: ingest_batch(store, df, n, as_of))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def resume_state(manifest: DataFrame) -> DataFrame:
    """Per run: where collection continues, or that it is complete.

    The last page is the one whose next cursor no page of the run has started from, so neither the
    names of pages nor the batches they came in matter; of several, a complete one, then the least cursor.
    """
    run = ["source", "run_id"]
    started = manifest.filter(F.col("input_cursor").isNotNull()).select(*run, F.col("input_cursor").alias("next_cursor")).distinct()
    ends = manifest.join(started, [*run, "next_cursor"], "left_anti").groupBy(*run).agg(
        F.min_by(F.struct("mode", "next_cursor", "complete"), F.struct(~F.coalesce("complete", F.lit(False)), "next_cursor")).alias("s")
    )
    scope = F.to_json(F.try_parse_json("scope"))  # the order of its keys and its spaces don't matter
    whole = manifest.groupBy(*run).agg(F.min("mode").alias("_m0"), F.max("mode").alias("_m1"), F.min(scope).alias("_s0"), F.max(scope).alias("_s1"))
    changed = (F.col("_m0") != F.col("_m1")) | (F.col("_s0") != F.col("_s1"))
    action = F.when(changed, "refuse_changed_configuration").when(F.col("s").isNull(), "refuse_circular_cursors").when(F.col("s.complete"), "nothing_to_do").otherwise("continue")
    return whole.join(ends, run, "left").select(*run, "s.mode", "s.next_cursor", "s.complete", action.alias("action"))


def replay_quarantine(quarantined: DataFrame, mapper, stored: DataFrame, content: str = "content") -> DataFrame:
    """Re-validate rejected originals under newer rules with their own observation time.

    ``mapper`` turns the rejected rows into rows with ``issue``, the event key and ``content``;
    the outcome per event says what a replay would append, so replaying twice adds nothing.
    """
    accepted = quarantined.transform(mapper).filter(F.col("issue").isNull())
    return event_outcomes(accepted, stored, content, ["ordinal"])
