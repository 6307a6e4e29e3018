"""The N best items of every group, however large some groups are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shatterlens.functions.names import fresh
from shatterlens.scratch import Scratch

#: Score bins to each power of two.
BINS = 256
#: Bin of an infinite score: beyond those of all finite ones, whose logarithms are within -1074 and 1024.
_TOP = 2200
#: Groups with more than this share of all rows get their threshold by broadcast: at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 50_000


def score_bin(score: Column, bins: int) -> Column:
    """Bin of a score: it never falls as the score rises, whatever the range of scores; one far outlier takes no resolution from the others."""
    size = F.abs(score.cast("double"))
    finite = F.floor((F.log2(size) + 1075) * bins)
    place = F.when(size == 0, 0).when(size == float("inf"), _TOP * bins).otherwise(finite).cast("int")
    return F.when(score < 0, -place).otherwise(place)


def top_n_per_group(items: DataFrame, group: str, score: str, n: int, ties: Sequence[Column], place: str = "place", bins: int = BINS, hot_share: float = HOT_SHARE) -> DataFrame:
    """The ``n`` rows of greatest ``score`` of each group with their ``place`` from 1 on.

    Rows with a NULL group, or a NULL or NaN score, take no part. Equal scores are ordered by
    ``ties``; rows equal there too are taken as equal. Infinite scores count as they compare. Other
    columns pass through; one named as ``place`` gives way to it. An empty table gives no rows.

    1. Histograms: rows are counted per (group, score bin), combined before the shuffle; bins are as wide as
       a 1 / ``bins`` part of a power of two. The
       threshold of a group is the highest bin at or above which it has ``n`` rows, so at least
       ``n`` rows reach it. Where that drops no row, only large groups have one, their lowest bin.
    2. Rows below the threshold are dropped. Thresholds of large groups are broadcast (fewer than
       ``1 / hot_share`` rows), so that these shrink before any shuffle; those of the others join by
       the shuffle that the ranking needs anyway.
    3. What is left is ranked exactly. Spark keeps only ``n`` rows per group and input partition
       before it shuffles, so even a group whose rows all tie never meets in one task.
    """
    scratch = Scratch(items.sparkSession)
    bin_, n_, cum, least, size, lowest, cold_least = fresh([*items.columns, place], "_bin", "_n", "_cum", "_least", "_size", "_lowest", "_least_cold")
    items = items.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    rows = scratch.save(items, "items").withColumn(bin_, score_bin(F.col(score), bins))
    total = rows.count()

    histogram = rows.groupBy(group, bin_).agg(F.count(F.lit(1)).alias(n_))
    downward = Window.partitionBy(group).orderBy(F.desc(bin_)).rowsBetween(Window.unboundedPreceding, 0)
    reached = histogram.withColumn(cum, F.sum(n_).over(downward))
    thresholds = reached.groupBy(group).agg(F.coalesce(F.max(F.when(F.col(cum) >= n, F.col(bin_))), F.min(bin_)).alias(least), F.max(cum).alias(size), F.min(bin_).alias(lowest))
    large = F.col(size) > F.lit(total * hot_share)
    thresholds = scratch.save(thresholds.where((F.col(least) > F.col(lowest)) | large).select(group, least, size), "thresholds")

    hot = thresholds.where(large).select(group, least)
    cold = thresholds.where(~large).select(group, F.col(least).alias(cold_least))
    marked = rows.join(F.broadcast(hot), group, "left")
    of_hot = marked.where(F.col(bin_) >= F.col(least)).drop(least, bin_)
    of_rest = marked.where(F.col(least).isNull()).drop(least).join(cold.hint("shuffle_hash"), group, "left")
    of_rest = of_rest.where(F.col(cold_least).isNull() | (F.col(bin_) >= F.col(cold_least))).drop(cold_least, bin_)
    order = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    ranked = lambda part: part.withColumn(place, F.row_number().over(order)).where(F.col(place) <= n)
    return ranked(of_hot).unionByName(ranked(of_rest))
