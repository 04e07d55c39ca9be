"""Append-only event sink and report sink; the first write of a key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_KEY = ("source", "source_id", "observed_at")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or no rows while nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def event_outcomes(
    incoming: DataFrame, stored: DataFrame, content: str, order: Sequence[str], keys: Sequence[str] = EVENT_KEY, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct (key, content) of a batch with its outcome.

    ``new`` is the first content of an unseen key; ``repeated`` equals what is stored or came
    first; ``conflicting`` differs from it. Copies are combined before the shuffle, so a key sent
    any number of times is one row.
    """
    hashed = incoming.withColumn("_hash", F.sha2(F.col(content), 256))
    position = F.struct(*order)
    distinct = hashed.groupBy(*keys, "_hash").agg(
        F.count(F.lit(1)).alias("arrivals"), F.min(position).alias("_at"),
        *[F.min_by(F.col(c), position).alias(c) for c in (content, *carry)],
    )
    first = distinct.groupBy(*keys).agg(F.min_by("_hash", "_at").alias("_first"))
    kept = stored.select(*keys, F.sha2(F.col(content), 256).alias("_stored")).distinct()
    d = distinct.join(first, list(keys)).join(kept, list(keys), "left")
    outcome = (
        F.when(F.col("_stored").isNotNull(), F.when(F.col("_stored") == F.col("_hash"), "repeated").otherwise("conflicting"))
        .when(F.col("_hash") == F.col("_first"), "new").otherwise("conflicting")
    )
    return d.withColumn("outcome", outcome).drop("_hash", "_first", "_stored", "_at")


def new_events(incoming: DataFrame, stored: DataFrame, content: str, order: Sequence[str], keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """First content of each unseen key: the rows that ``event_outcomes`` calls new, without judging the others.

    An unknown part of a key is a value of its own, and so is unknown content.
    """
    first = incoming.groupBy(*keys).agg(F.min_by(content, F.struct(*order)).alias(content))
    seen = stored.select(*[F.col(k).alias("_" + k) for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_" + k))
    return first.join(seen.hint("merge"), same, "left_anti")


def append_new(events: DataFrame, path: str) -> None:
    """Append new events, partitioned by source."""
    events.write.mode("append").partitionBy("source").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write report rows partitioned by run; a run already written is left untouched."""
    spark = report.sparkSession
    seen = read_or_empty(spark, path, report.schema).select("run_id").distinct()
    report.join(seen, "run_id", "left_anti").write.mode("append").partitionBy("run_id").parquet(path)
