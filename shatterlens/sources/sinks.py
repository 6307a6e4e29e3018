"""Writers of result tables."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, functions as F


def write_points(points: DataFrame, root: str, order: str = "step") -> None:
    """Curves partitioned by dataset and method, sorted within each file."""
    points.repartition("dataset", "method").sortWithinPartitions("dataset", "method", order).write.mode("overwrite").partitionBy("dataset", "method").parquet(root)


def write_csv(table: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with a header and, with ``mark``, a byte order mark; Spark commits it by renaming, so a reader never sees half of it."""
    first = table.columns[0]
    table.withColumnRenamed(first, f"\ufeff{first}" if mark else first).write.mode("overwrite").csv(path, header=True)


def write_or_beside(table: DataFrame, path: str, beside: str) -> str:
    """Write parquet to ``path``, or to ``beside`` if that may not be written to; where it went."""
    for target in (path, beside):
        try:
            table.write.mode("overwrite").parquet(target)
            return target
        except Exception as e:  # the cause is the file system's, some layers down
            if target == beside or not any(x in str(e).lower() for x in ("permission", "access denied", "accesscontrol", "mkdirs failed", "cannot create")):
                raise
    return beside


def manifest(points: DataFrame, root: str) -> DataFrame:
    """(dataset, method, rows, path) of the written curves."""
    counted = points.groupBy("dataset", "method").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("path", F.concat(F.lit(f"{root}/dataset="), "dataset", F.lit("/method="), "method"))


def write_json(record: dict, path: str) -> None:
    """A small manifest as one JSON file, put in place by a rename."""
    target = Path(path)
    draft = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    draft.write_text(json.dumps(record, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    draft.replace(target)


def append_log(rows: DataFrame, path: str) -> None:
    """More rows to a log; nothing that is there is written again."""
    rows.write.mode("append").json(path)


def write_version(table: DataFrame, root: str, version: str) -> str:
    """A new version of a table beside the old ones; FileExistsError if it is there."""
    path = f"{root}/version={version}"
    table.write.mode("errorifexists").parquet(path)
    return path


def tree_edges(records: DataFrame) -> DataFrame:
    """(source, target, idx, valid) of records with a parent."""
    return records.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != "")).select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"), "idx", "valid")
