"""Running sums and ranks over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shatterlens.functions.names import fresh
from shatterlens.scratch import Scratch


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row, in ``order`` within ``keys``; rows that tie on it share one order of their own.

    Rows are sorted by range over all tasks; each task sums its own part of a group, and the sums
    of the parts before it (one row a group and task) are added. No group is ever in one task.
    """
    scratch = Scratch(df.sparkSession)
    parts = scratch.save(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "parts")
    inner = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy(*keys, "_part").agg(F.sum(value).alias("_own"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).drop("_own")
    return parts.withColumn(name, F.sum(value).over(inner)).join(sums, [*keys, "_part"]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


#: Rows of a table up to which numbering within groups is one plain window.
PLAIN_ROWS = 1_000_000


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """``name``: the place of each row in its group from 1, by ``order``, which should leave no ties.

    A table of more than ``plain_rows`` rows is sorted by range over all tasks, each numbers its own
    part, and the sizes of the parts before it are added: a group as large as the table is no one task's.
    """
    scratch = Scratch(df.sparkSession)
    if plain_rows:
        df = scratch.save(df, "rows")
        if df.count() <= plain_rows:
            return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    part, own, before = fresh(df.columns, "_part", "_own", "_before")
    parts = scratch.save(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "parts")
    sizes = parts.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(own))
    ahead = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum(own).over(ahead), F.lit(0))).drop(own)
    place = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
    out = parts.withColumn(name, place).join(sizes, [*keys, part])
    return out.withColumn(name, (F.col(name) + F.col(before)).cast("int")).drop(part, before)


def global_average_rank(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """Average rank of ``value`` over the whole table, without a single-task window; NULL and NaN are unranked."""
    known = F.when(~F.isnan(F.col(value)), F.col(value))
    by = -known if descending else known
    counts = df.select(by.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    ranks = running_sum(counts, ["_all"], ["_v"], "_n", "_upto").select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.withColumn("_v", by).join(ranks, "_v", "left").drop("_v")


def average_rank(value: Column, keys: list[str], descending: bool = False) -> Column:
    """Average rank within ``keys``; NULL where the value is NULL (NaN should be NULL by then)."""
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_last(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2)
