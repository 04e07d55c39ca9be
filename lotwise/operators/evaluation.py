"""Measured errors of frozen predictions and of identity extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_failure
from ..functions.urls import public_https
from ..session import cut_lineage
from .ordered import middle, order_statistics
from .temporal import pick_first

CENTS_LIMIT = 1_000_000_000


def _cents(name: str, positive: bool = False) -> Column:
    return F.coalesce(F.col(name).between(1 if positive else 0, CENTS_LIMIT), F.lit(False))


def judge_predictions(rows: DataFrame, training: DataFrame, model_version: str, as_of: Column, order: Sequence[str]) -> DataFrame:
    """Add ``reason``: NULL for a usable holdout row, otherwise the first rule it breaks.

    Leaked vehicles, repeats, other models, unattested sales and impossible times are rejected.
    """
    seen = training.select(F.trim("vehicle_id").alias("_v")).distinct().withColumn("_trained", F.lit(True))
    d = rows.withColumn("_v", F.trim("vehicle_id")).join(seen, "_v", "left")
    reason = first_failure(
        ("vehicle missing or used in training", F.coalesce(F.col("_v") == "", F.lit(True)) | F.col("_trained").isNotNull()),
        ("different model version", ~F.col("model_version").eqNullSafe(F.lit(model_version))),
        ("sale not attested", ~F.coalesce(F.col("verified") & (F.trim("verified_by") != "") & (F.col("data_kind") == "observed_transaction"), F.lit(False))),
        ("evidence url", ~public_https("evidence_url")),
        ("temporal leakage", ~F.coalesce(
            (F.col("training_cutoff") <= F.col("predicted_at")) & (F.col("predicted_at") < F.col("sold_at")) & (F.col("sold_at") <= as_of), F.lit(False))),
        ("prices must be positive", ~(_cents("predicted_cents", True) & _cents("sold_cents", True))),
        ("interval", ~(_cents("interval_low_cents") & _cents("interval_high_cents"))
            | (F.col("interval_low_cents") > F.col("predicted_cents")) | (F.col("interval_high_cents") < F.col("predicted_cents"))),
        ("segment required", F.coalesce(F.trim("segment") == "", F.lit(True))),
    )
    judged = d.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull())
    first = pick_first(good, ["_v"], [F.col(c) for c in order])
    repeats = good.join(first.select(*order), list(order), "left_anti").withColumn("reason", F.lit("duplicated vehicle"))
    return first.unionByName(repeats).unionByName(judged.filter(F.col("reason").isNotNull())).drop("_v", "_trained")


def error_metrics(accepted: DataFrame, segment: str = "segment", minimum: int = 30) -> DataFrame:
    """Error, bias, coverage and overpricing overall (segment NULL) and per segment.

    Means are one pass; medians and ninetieths come from counts per value, dealt by ranges, so that no
    task holds all errors.
    """
    d = accepted.select(
        F.col(segment).alias("segment"),
        (F.col("predicted_cents") - F.col("sold_cents")).alias("e"),
        (F.abs(F.col("predicted_cents") - F.col("sold_cents")) / F.col("sold_cents") * 100).alias("pct"),
        F.col("sold_cents").between(F.col("interval_low_cents"), F.col("interval_high_cents")).cast("int").alias("covered"),
    ).withColumn("a", F.abs("e")).withColumn("over", F.greatest(F.lit(0), F.col("e")))
    d = cut_lineage(d, "errors")  # read for the means and for the ranks
    # Every row counts for the whole and for its segment, once for each of the three measures.
    scopes = F.array(F.struct(F.lit(1).alias("_all"), F.lit(None).cast("string").alias("_seg")), F.struct(F.lit(0).alias("_all"), F.col("segment").cast("string").alias("_seg")))
    measures = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in ("a", "pct", "over")))
    long = d.withColumn("s", F.explode(scopes)).withColumn("m", F.explode(measures)).select("s._all", "s._seg", "m.measure", "m.value")
    picked = order_statistics(long, ["_all", "_seg", "measure"], "value", {**middle(F.col("n")), "ninetieth": F.ceil(F.col("n") * 9 / 10)})
    of = lambda measure, c: F.max(F.when(F.col("measure") == measure, c))
    ranks = picked.groupBy("_all", "_seg").agg(
        F.bround(of("pct", (F.col("middle_low") + F.col("middle_high")) / 2), 3).alias("median_ape"),
        of("a", F.col("ninetieth")).cast("bigint").alias("p90_abs_error_cents"), of("over", F.col("ninetieth")).cast("bigint").alias("p90_overpricing_cents"),
    ).withColumnRenamed("_all", "_whole")
    means = (
        d.groupingSets([[], [F.col("segment")]], F.col("segment"))
        .agg(
            F.grouping("segment").cast("int").alias("_all"),
            F.count(F.lit(1)).alias("n"),
            F.bround(F.avg("a"), 0).cast("bigint").alias("mae_cents"),
            F.bround(F.avg("e"), 0).cast("bigint").alias("bias_cents"),
            F.bround(F.avg("covered"), 4).alias("interval_coverage"),
            F.bround(F.avg((F.col("e") > 0).cast("int")), 4).alias("overpricing_fraction"),
        )
    )
    joined = means.join(ranks, (F.col("_all") == F.col("_whole")) & F.col("segment").cast("string").eqNullSafe(F.col("_seg")), "left")
    return (
        joined
        .withColumn("scope", F.when(F.col("_all") == 1, "overall").otherwise("segment"))
        .withColumn("sufficient_sample", F.col("n") >= minimum)
        .drop("_all", "_whole", "_seg")
    )


def repair_underestimates(accepted: DataFrame) -> DataFrame:
    gap = F.col("actual_repair_cents") - F.col("predicted_repair_high_cents")
    return accepted.agg(
        F.count(gap).alias("repair_samples"), F.count_if(gap > 0).alias("repair_underestimates"),
        F.bround(F.avg(F.greatest(gap, F.lit(0))), 0).cast("bigint").alias("mean_repair_underestimate_cents"),
    )


def identity_evaluation(resolved: DataFrame, reviewed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answered, right and abstained per field against reviewed labels.

    ``resolved`` has keys, field, value, status; ``reviewed`` has keys, field, expected.
    """
    d = reviewed.filter(F.col("expected").isNotNull()).join(resolved, [*keys, "field"], "left")
    abstained = F.col("status").isNull() | F.col("status").isin("missing", "conflict")
    right = ~abstained & F.col("value").eqNullSafe(F.col("expected"))
    out = d.groupBy("field").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(right).alias("correct"),
        F.count_if(~abstained & ~right).alias("incorrect"), F.count_if(abstained).alias("abstained"),
    )
    answered = F.col("correct") + F.col("incorrect")
    return out.withColumn("accuracy_when_answered", F.try_divide(F.col("correct"), answered)).withColumn(
        "coverage", F.try_divide(answered, F.col("checked"))
    )
