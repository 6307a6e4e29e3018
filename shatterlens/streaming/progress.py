"""Live views of growing logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 10) -> DataFrame:
    """Rows of a folder of parquet files as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def progress(log: DataFrame, key: str) -> DataFrame:
    """Rows and sums so far per key; for complete mode."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))


def windowed(log: DataFrame, time: str, key: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Rows per key and tumbling window; a window is given out once it is ``late`` past, later rows are dropped."""
    out = log.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("w.start").alias("start"), key, "rows")


def credit_stream(rewards: DataFrame, key: str, keep: float = 0.82, time: str | None = None, idle: str = "7 days") -> DataFrame:
    """(key, credit, n) after each batch: an exponential moving credit held as state.

    With a ``time`` column the state of a key that has had no rewards for ``idle`` is dropped, with its last row once
    more, and rewards that come later than that are too late; without one it is kept.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        credit, n = state.get if state.exists else (0.0, 0)
        if state.hasTimedOut:
            state.remove()
        else:
            latest = 0
            for pdf in batches:
                latest = max(latest, int(pdf["_ms"].max()))
                for reward in pdf.sort_values("idx")["reward"]:
                    credit, n = keep * credit + (1 - keep) * reward, n + 1
            state.update((credit, n))
            if time:
                state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [name[0]], "credit": [credit], "n": [n]})

    schema = f"{key} string, credit double, n bigint"
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    rows = rewards.withWatermark(time, idle).withColumn("_ms", F.unix_millis(time)) if time else rewards.withColumn("_ms", F.lit(0))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "credit double, n bigint", "update", timeout)
