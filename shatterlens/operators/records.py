"""Records that are delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shatterlens.functions.names import fresh


def current_rows(df: DataFrame, keys: list[str], version: str, columns: list[str], arrival: str | None = None) -> DataFrame:
    """One row per key: ``columns`` of the row with the greatest ``version``.

    NULL keys form keys of their own and a NULL version is older than any other. Rows that tie on
    ``version`` are taken as equal; if they are not, the greatest (columns in their order) wins, so
    the result never depends on the order of rows. ``arrival`` names an optional column with the
    least version of the key. An empty table gives no rows.
    """
    v, row = fresh([*keys, *columns, arrival or ""], "_version", "_row")
    aggs = [F.max(F.struct(F.col(version).alias(v), *[F.col(c) for c in columns])).alias(row)]
    if arrival:
        aggs.append(F.min(version).alias(arrival))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"`{row}`.`{c}`").alias(c) for c in columns], *([arrival] if arrival else []))
