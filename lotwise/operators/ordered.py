"""Ranks, running totals and order statistics of whole tables, without a task that holds a whole group.

Rows are dealt to partitions by ranges of (group, order) and written once. Each partition then knows
its own part of every group; what lies before it is a running sum over one small row for each
partition and group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of the place within a partition in Spark's increasing ids.
_PLACE = 33


def _joined(rows: DataFrame, starts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with what is known of their partition and group; an unknown group value is a value of its own."""
    renamed = starts.withColumnsRenamed({c: f"_s{c}" for c in ("_part", *group)})
    on = F.col("_part") == F.col("_s_part")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    return rows.join(renamed, on).drop("_s_part", *(f"_s{c}" for c in group))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """``df`` with the rank of each row within its group, from 1, and the group's size as ``total``.

    ``order`` should tell rows apart: rows that agree on it share a partition, and any of them may come
    first. One shuffle of the rows; the group's sizes before each partition are a small table.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    placed = df.repartitionByRange(*(F.col(c) for c in group), *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "ranked").withColumn("_part", F.shiftright("_id", _PLACE))
    counts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).withColumn("_total", F.sum("_n").over(whole)).drop("_n")
    out = _joined(placed, starts, group).withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1)
    out = out if total is None else out.withColumn(total, F.col("_total"))
    return out.drop("_id", "_part", "_first", "_before", "_total")


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str, total: str | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` within its group, itself included, and the group's sum as ``total``."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    placed = cut_lineage(df.repartitionByRange(*(F.col(c) for c in group), *order).withColumn("_part", F.spark_partition_id()), "running")
    sums = placed.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", before).withColumn("_total", F.sum("_sum").over(whole)).drop("_sum")
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(placed.withColumn("_inside", F.sum(value).over(inside)), starts, group).withColumn(name, F.col("_before") + F.col("_inside"))
    out = out if total is None else out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_inside", "_before", "_total")


def order_statistics(df: DataFrame, group: Sequence[str], value: str, needs: Mapping[str, Column]) -> DataFrame:
    """One row a group with its number of values ``n`` and the values at stated ranks.

    ``needs`` maps names to ranks, from 1, as expressions of ``n``. Values are counted first, so however
    many rows share one, it is a single row; null values don't count. Groups without a value have no row; the
    whole table, where it has none, a row of nulls.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_count"))
    run = running(counted, group, [F.col(value)], "_count", "_upto", "n")
    picked = run.withColumns({f"_need_{name}": need.cast("bigint") for name, need in needs.items()})
    holds = {name: (F.col("_upto") >= F.col(f"_need_{name}")) & (F.col("_upto") - F.col("_count") < F.col(f"_need_{name}")) for name in needs}
    return picked.groupBy(*group).agg(F.first("n").alias("n"), *(F.max(F.when(hit, F.col(value))).alias(name) for name, hit in holds.items()))


def middle(n: Column) -> dict[str, Column]:
    """Ranks of the two middle values, equal for an odd number."""
    return {"middle_low": F.floor((n + 1) / 2), "middle_high": F.floor(n / 2) + 1}
