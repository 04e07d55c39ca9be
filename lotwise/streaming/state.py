"""Keyed state and incremental projections over event streams."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.temporal import KEY, not_yet_projected, pick_first


def latest_state(stream: DataFrame, fields: Sequence[str], keys: Sequence[str] = KEY, ties: Sequence[str] = ()) -> DataFrame:
    """Streaming newest version per key as a native aggregation: state is one row per key.

    No watermark: a late older version is accepted and simply does not win.
    """
    order = F.struct("observed_at", *ties)
    return stream.groupBy(*keys).agg(
        F.max_by(F.struct("observed_at", *ties, *fields), order).alias("latest"), F.count(F.lit(1)).alias("versions")
    ).select(*keys, "versions", "latest.*")


def upsert_sink(path: str, keys: Sequence[str] = KEY) -> Callable[[DataFrame, int], None]:
    """Writer for update-mode batches: one sub-folder per batch, the newest batch wins on read."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(os.path.join(path, f"b{batch}"))

    return write


def read_state(spark: SparkSession, path: str, keys: Sequence[str] = KEY) -> DataFrame:
    return pick_first(spark.read.parquet(os.path.join(path, "*")), keys, [F.col("batch").desc()]).drop("batch")


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Process everything available, then stop; a restart resumes from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def projection_writer(path: str, project: Callable[[DataFrame], DataFrame], keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Append only events whose key is not projected yet, whatever order they arrive in."""

    def write(df: DataFrame, batch: int) -> None:
        from pyspark.errors import AnalysisException

        # Of several events of a key in a batch, the least in all columns: the same one on every run.
        events = pick_first(df, keys, [F.col(c).asc_nulls_last() for c in df.columns if c not in keys])
        try:
            done = df.sparkSession.read.parquet(os.path.join(path, "*")).filter(F.col("batch") != batch)
            events = not_yet_projected(events, done, keys)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        project(events).withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(os.path.join(path, f"b{batch}"))

    return write
