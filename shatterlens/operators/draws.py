"""Draws by hash: the same rows, keys and seed give the same draw in any order of rows, any partitioning and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from shatterlens.functions.names import fresh


def unit(*parts: Column | str | int) -> Column:
    """An even number in (0, 1): the first 32 bits of the MD5 of the parts, joined by ``|``; column names are given as columns."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") + 0.5) / 4294967296.0


def normal(*parts: Column | str | int) -> Column:
    """A standard normal number, from two even ones."""
    return F.sqrt(-2.0 * F.log(unit(*parts, "radius"))) * F.cos(2 * math.pi * unit(*parts, "angle"))


def one_per_key(pool: DataFrame, keys: list[str], item: str, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """One row of each key, with chance proportional to ``weight`` (even without one): the least -ln(u) / weight, ties by ``item``."""
    clock, n = fresh(pool.columns, "_clock", "_n")
    wait = -F.log(unit(*[F.col(k) for k in keys], F.col(item), seed)) / (weight if weight is not None else F.lit(1.0))
    placed = pool.withColumn(clock, wait).withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(clock, item)))
    return placed.where(F.col(n) == 1).drop(clock, n)


def chance(share: float, keys: list[str], seed: int, name: str = "coin") -> Column:
    """Whether a key's coin of that ``share`` falls."""
    return unit(*[F.col(k) for k in keys], seed, name) < share


def beta(rows: DataFrame, keys: list[str], a: str, b: str, seed: int = 0, name: str = "theta") -> DataFrame:
    """Rows, unique on ``keys``, with a draw of Beta(a, b) for whole a and b: the a-th least of a + b - 1 even numbers.

    The numbers are made as rows, so that a large b is many short rows and no long array.
    """
    drawn = rows.select(*keys, F.col(a).alias("_a"), F.explode(F.sequence(F.lit(1), F.col(a) + F.col(b) - 1)).alias("_i"))
    drawn = drawn.withColumn("_u", unit(*[F.col(k) for k in keys], F.col("_i"), seed))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_u", "_i"))
    chosen = drawn.withColumn("_n", place).where(F.col("_n") == F.col("_a")).select(*keys, F.col("_u").alias(name))
    return rows.join(chosen, keys)
