"""Listing files and paged exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import parse_listings
from ..schema import LISTING_SCHEMA, PAGE_SCHEMA

_SCALARS = T.StructType([f for f in LISTING_SCHEMA if not isinstance(f.dataType, T.ArrayType)])


def read_raw_listings(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Listings of a JSON array file, JSON lines or headed CSV, with the fixed schema."""
    if fmt == "json":
        return spark.read.schema(LISTING_SCHEMA).option("multiLine", True).json(path)
    if fmt == "jsonl":
        return spark.read.schema(LISTING_SCHEMA).json(path)
    if fmt == "csv":
        text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        # Columns are found by their header, in any order; a value that does not fit is missing.
        return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in _SCALARS if f.name in text.columns])
    raise ValueError("format must be json, jsonl or csv")


def import_listings(spark: SparkSession, path: str, fmt: str, as_of: Column) -> DataFrame:
    """All-or-nothing import: any invalid row stops it, naming one issue."""
    valid, invalid = parse_listings(read_raw_listings(spark, path, fmt), as_of)
    worst = invalid.select("issue").head()
    if worst is not None:
        raise ValueError(f"import refused: {worst['issue']}")
    return valid


def import_counts(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("source", "source_id", "observed_at")) -> DataFrame:
    """Rows received, inserted and already present."""
    arrivals = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    return arrivals.join(known, list(keys), "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("received"), F.count_if(F.col("_known").isNull()).alias("inserted")
    ).withColumn("duplicates", F.col("received") - F.col("inserted"))


def read_export(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Records of a paged export: one row per record with its page and position.

    An export is one JSON document per file, or one per line when ``whole_file`` is off.

    The page index is the cursor, and only the last page completes the run.
    """
    outer = T.StructType([T.StructField("source", T.StringType()), T.StructField("pages", T.ArrayType(T.ArrayType(PAGE_SCHEMA["records"].dataType.elementType)))])
    export = spark.read.schema(outer).option("multiLine", whole_file).json(path)
    pages = export.select("source", F.size("pages").alias("page_count"), F.posexplode("pages").alias("page_no", "records"))
    return pages.select(
        "source", "page_no", ((F.col("page_no") + 1) == F.col("page_count")).alias("complete"), F.posexplode("records").alias("ordinal", "record")
    ).select("source", "page_no", "complete", "ordinal", "record.*")
