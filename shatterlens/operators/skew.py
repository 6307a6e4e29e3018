"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shatterlens.functions.names import fresh

#: A key is hot if it holds at least this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
#: Below this many rows a key is never hot: one task takes it easily.
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, keys: list[str], total: int, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``max(total * share, least)`` rows: never more than ``1 / share`` rows.

    The count combines on the map side, so a hot key costs one row per input partition.
    """
    floor = max(int(total * share), least)
    (n,) = fresh(keys, "_n")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) >= floor).select(*keys)


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, *, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Left outer join on ``keys`` against a ``right`` side that is unique on them.

    Rows of hot keys meet only the (at most ``1 / share``) right rows of these keys, which are
    broadcast; all others are joined by shuffle. NULL keys match nothing. ``total`` is the number
    of rows of ``left``. Every left row comes out exactly once.
    """
    if total < least:  # no key can be hot
        return left.join(right, keys, "left")
    hot = hot_keys(left.dropna(subset=keys), keys, total, share, least)
    if hot.isEmpty():
        return left.join(right, keys, "left")
    (mark,) = fresh([*left.columns, *right.columns], "_hot")
    marked = left.join(F.broadcast(hot.withColumn(mark, F.lit(True))), keys, "left")
    hot_side = right.join(F.broadcast(hot), keys, "left_semi")
    few = marked.where(F.col(mark)).drop(mark).join(F.broadcast(hot_side), keys, "left")
    rest = marked.where(F.col(mark).isNull()).drop(mark).join(right, keys, "left")
    return few.unionByName(rest)
