"""Benchmark decontamination by winnowing.

Of every window of consecutive word k-grams the one of least hash is kept, on documents and on
benchmark items alike. A shared span of ``window`` words holds a whole window of k-grams, so both
sides keep the same one: no such span is missed. Hits are then extended word by word, and only runs
of at least ``window`` equal words count.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.session import cut_lineage

#: Index rows up to which the benchmark is sent to every executor (about 200 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000
_POSITION_BITS = 30
_NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not once for every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters and whatever lies beyond ASCII; none for null."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    # lower() is the quick way where it can't touch letters beyond ASCII.
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, lower)).otherwise(F.lower(text))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), _NOT_A_WORD), "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _entries(h: Column, window: int, k: int, short: tuple[int, ...]) -> Column:
    """Struct array (span, fp, pos, first, context): kept k-grams, and all n-grams of the short lengths."""
    n = F.size(h)
    back, reach = window - k, 2 * window - k

    def entry(span: Column, fp: Column, pos: Column, reach_back: int, width: int) -> Column:
        first = F.greatest(pos - reach_back, F.lit(0))
        return F.struct(span.alias("span"), fp.alias("fp"), pos.alias("pos"), first.alias("first"), F.slice(h, first + 1, F.lit(width)).alias("context"))

    def gram(i: Column, x: Column, length: int, *salt: Column) -> Column:
        return F.xxhash64(*salt, x, *(F.get(h, i + j) for j in range(1, length)))

    # The hash in the upper bits and the position in the lower: the least is the leftmost of the least hashes.
    coded = F.transform(F.slice(h, F.lit(1), F.greatest(n - (k - 1), F.lit(0))), lambda x, i: F.shiftleft(gram(i, x, k), _POSITION_BITS).bitwiseOR(i.cast("bigint")))
    least = lambda c: F.transform(F.slice(c, F.lit(1), F.greatest(n - (window - 1), F.lit(0))), lambda x, i: F.least(x, *(F.get(c, i + j) for j in range(1, window - k + 1))))
    kept = F.array_distinct(_bound(coded, least))
    entries = [F.transform(kept, lambda c: entry(F.lit(window), F.shiftright(c, _POSITION_BITS), c.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int"), back, reach))]

    def grams(length: int) -> Column:
        first = F.slice(h, F.lit(1), F.greatest(n - (length - 1), F.lit(0)))
        return F.transform(first, lambda x, i: entry(F.lit(length), gram(i, x, length, F.lit(length)), i, 0, length))

    entries += map(grams, short)
    return reduce(F.concat, entries)


def _item_index(benchmark: DataFrame, window: int, k: int, short: tuple[int, ...]) -> DataFrame:
    """Benchmark fingerprints; items that agree around one share a row."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), _hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    # Each item is indexed at its own length only.
    own = F.when(F.size("h") >= window, _entries(F.col("h"), window, k, ()))
    for length in short:
        own = own.when(F.size("h") == length, F.slice(_entries(F.col("h"), window, k, (length,)), 1, 1))
    rows = items.select("item_id", F.explode(own).alias("e")).select("item_id", "e.*")
    return rows.groupBy(F.col("span").alias("i_span"), F.col("fp").alias("i_fp"), (F.col("pos") - F.col("first")).alias("i_at"), F.col("context").alias("i_context")).agg(F.collect_set("item_id").alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Words of documents that lie in a span of ``window`` words shared with a benchmark item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. An item of fewer words is one window
    of its own length; one without words has none. Returns a row for each document row: doc_id, n_words,
    n_hit, ``spans`` (start, length; the shared runs, overlapping), ``items`` (ids as strings, sorted).

    Null and empty texts have no words. Null doc_ids and repeated rows are rows of their own. A null
    item_id is the empty string; equal ids count once. Empty tables give no rows or no hits; extra
    columns are not read. Words are compared by 64-bit hashes, window by window.
    """
    n_item = F.size(words(F.col("text")))
    lengths = benchmark.select(n_item.alias("n")).where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()  # at most window - 1 values
    short = tuple(sorted(r["n"] for r in lengths))
    index = _item_index(benchmark, window, k, short)
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = F.broadcast(index)

    # One pass over the documents: every row also sends an entry of its own, which matches nothing and carries the counts.
    own = F.struct(F.lit(-1).alias("span"), F.col("row").alias("fp"), F.lit(0).alias("pos"), F.lit(0).alias("first"), F.array().cast("array<bigint>").alias("context"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _bound(_hashes(F.col("text")), lambda h: F.struct(F.size(h).cast("bigint").alias("n"), _entries(h, window, k, short).alias("entries"))).alias("f"))
    entries = rows.select("doc_id", "row", F.col("f.n").alias("n_words"), F.explode_outer(F.concat(F.array(own), F.col("f.entries"))).alias("e")).select("doc_id", "row", "n_words", "e.*")
    met = entries.join(index, (F.col("span") == F.col("i_span")) & (F.col("fp") == F.col("i_fp")), "left").where((F.col("span") == -1) | F.col("i_fp").isNotNull())

    at, i_at = F.col("pos") - F.col("first"), F.col("i_at")
    before = F.aggregate(F.sequence(F.lit(1), F.lit(window)), F.lit(0), lambda a, t: F.when((a == t - 1) & (F.get("context", at - t) == F.get("i_context", i_at - t)), t).otherwise(a))
    after = F.aggregate(F.sequence(F.lit(0), F.lit(window)), F.lit(0), lambda a, t: F.when((a == t) & (F.get("context", at + t) == F.get("i_context", i_at + t)), t + 1).otherwise(a))
    runs = met.withColumn("before", F.when(F.col("span") > 0, before)).withColumn("after", F.when(F.col("span") > 0, after))
    holds = F.col("before") + F.col("after") >= F.col("span")
    span = F.struct((F.col("pos") - F.col("before")).alias("start"), (F.col("before") + F.col("after")).alias("length"))
    found = runs.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(holds, span))).alias("spans"), F.collect_set(F.when(holds, F.col("items"))).alias("items"),
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
            (a["total"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("total"),
        ),
        lambda a: a["total"],
    )
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "spans", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def contamination_digest(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`find_contamination`."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Documents that share no window with the benchmark, with all their columns.

    Rows are matched on the SHA-256 of the text, so rows of equal text share one decision whatever
    their ids are; null texts stay. Only digests of contaminated texts travel.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    found = find_contamination(docs.select(digest.alias("doc_id"), "text"), benchmark, window, k)
    bad = cut_lineage(found.where("n_hit > 0").select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    few = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.withColumn("__digest", digest).join(F.broadcast(bad) if few else bad, F.col("__digest") == F.col("__bad"), "left_anti").drop("__digest")
