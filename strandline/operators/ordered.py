"""Window analytics over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def margin(df: DataFrame, left: str, score: str, order: list[Column]) -> DataFrame:
    """The best row per left key with the runner-up's score (null without one)."""
    w = Window.partitionBy(left).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).withColumn("runner_up", F.lead(score).over(w)).where("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per group with ``rank``; the row-number filter is pushed into a group limit before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def neighbours(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the row before and after within a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def carried(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last known value stays in effect for the following rows of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, group: list[str], order: list[str], boundary: Column, name: str = "island") -> DataFrame:
    """Number of the stretch a row belongs to; a row for which ``boundary`` holds begins a new one."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_b", F.coalesce(boundary, F.lit(False)).cast("int")).withColumn(name, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def within_budget(df: DataFrame, group: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """The rows of each group whose running cost before them is below the budget."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(F.col("spent_before") < budget)


def period_ends(periods: DataFrame, start: str, group: list[str] | None = None) -> DataFrame:
    """Each period ends the day before the next one starts; the last has no end."""
    return periods.withColumn("ends", F.date_sub(F.lead(start).over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(start)), 1))


def merged_timeline(a: DataFrame, b: DataFrame, group: list[str], day: str, pos: str) -> DataFrame:
    """Two lists as one by day; an undated row takes the day of the row before it; rows of ``a`` first on ties."""
    both = carried(a.withColumn("side", F.lit(0)), group, [pos], day, "at").unionByName(carried(b.withColumn("side", F.lit(1)), group, [pos], day, "at"))
    return both.withColumn("line", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("at").asc_nulls_first(), "side", pos)))


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Number all rows from 1 in ``order``, which should be total, without putting them into one task.

    Rows are dealt over ranges of the order and written; each range is numbered
    by itself, from the sum of the ranges before it. Only the ranges' sizes, a row each, pass through one task.
    """
    from strandline.sources.shared import written

    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    placed = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return placed.join(F.broadcast(sizes), "_range").select(*df.columns, (F.col("_from") + F.col("_at")).alias(name))
