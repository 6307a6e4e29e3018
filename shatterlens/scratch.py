"""Intermediate tables in the folder that all executors share.

Iterative operators and operators that read an intermediate result several times write it as
parquet below ``spark.checkpoint.dir``. A lost executor then costs a re-read and not the lineage,
and adaptive execution knows the true sizes.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_roots: list[str] = []
_owner = os.getpid()


@atexit.register
def _clear() -> None:
    """When the driver's Python ends: delete its tables, where the shared folder is a path here."""
    for root in _roots if os.getpid() == _owner else ():  # a forked child deletes nothing
        path = root.removeprefix("file://").removeprefix("file:")
        if path.startswith("/"):
            shutil.rmtree(path, ignore_errors=True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators of this process wrote; results that read them must be written by then."""
    while _roots:
        _delete(spark, _roots.pop())


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get("root")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    holder = tempfile.TemporaryDirectory(prefix="shatterlens-")
    atexit.register(holder.cleanup)
    _own_dir["root"] = holder.name
    return holder.name


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator call: written once, read many times, dropped one by one."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/shatterlens-{uuid.uuid4().hex}"
        self._path_of: dict[int, str] = {}
        self._kept: list[DataFrame] = []
        self._n = 0
        _roots.append(self.root)

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and return a frame that reads the written files."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._path_of[id(out)] = path
        self._kept.append(out)  # so that no other frame gets its id
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        path = self._path_of.pop(id(df), None)
        if path:
            _delete(self.spark, path)
