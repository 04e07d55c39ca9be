"""A corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input, in their order, whatever their names and
values: the columns that a stage works on are doc_id and text (and n_chars, where there is one). Null
texts count as empty, null ids as ids like others, repeated rows each by themselves except where copies are
what a stage removes; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import decontamination, line_dedup, near_copies, packing, toxicity
from lotwise.session import cut_lineage


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names of the stage's own for all other columns, so that none clashes, and the way back."""
    away = {c: f"__kept{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    return docs.withColumnsRenamed(away), {new: old for old, new in away.items()}


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels outside the held-out fold, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    named, back = _aside(docs)
    model = toxicity.train(named, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(named, model).where("predicted = 0").select(*named.columns).withColumnsRenamed(back)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that equal or nearly equal an earlier one; n_chars follows the text."""
    named, back = _aside(docs)
    cleaned = line_dedup.dedup_lines(named)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*named.columns).withColumnsRenamed(back)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    named, back = _aside(docs)
    return near_copies.one_of_each(named).select(*named.columns).withColumnsRenamed(back)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    named, back = _aside(docs)
    kept = decontamination.without_contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return kept.select(*named.columns).withColumnsRenamed(back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents in sequences of at most 1024 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Tokenizing, learned scores and hashes can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
