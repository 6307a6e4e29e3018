"""Readers of the files that a dismantling study keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shatterlens.functions.scalars import json_object


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, with or without a byte order mark; nan and empty numbers are NULL."""
    return spark.read.csv(path, header=True, schema=schema, nanValue="\0none", enforceSchema=False, nullValue="").na.replace("nan", None)


def read_columns(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """The wanted columns that a CSV has, as text; only these are parsed."""
    df = spark.read.csv(path, header=True)
    return df.select(*[c for c in wanted if c in df.columns])


def read_points(spark: SparkSession, root: str) -> DataFrame:
    """Curves in a folder per dataset and method (dataset=.../method=...): partitions are pruned by both."""
    return spark.read.option("basePath", root).parquet(root)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are no object are dropped."""
    kinds = f"{schema}, _bad string"
    rows = spark.read.schema(kinds).option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    return rows.where("_bad is null").drop("_bad")


def recorded_order(rows: DataFrame, graph: str, method: str) -> DataFrame:
    """(graph, method, step, node) of a table with step and removed_node (text): steps above 0, nodes that are integers."""
    node = F.regexp_replace(F.trim(F.col("removed_node").cast("string")), r"\.0+$", "").try_cast("bigint")
    good = rows.select(F.col("step").cast("int").alias("at"), node.alias("node")).where("at > 0 and node is not null")
    w = Window.partitionBy(F.lit(0)).orderBy("at")  # one recorded order
    return good.select(F.lit(graph).alias("graph"), F.lit(method).alias("method"), F.row_number().over(w).alias("step"), "node")


def recorded_time(rows: DataFrame, column: str = "total_time_s") -> DataFrame:
    """The first known time of a recorded order."""
    return rows.agg(F.min_by(F.col(column).try_cast("double"), F.when(F.col(column).try_cast("double").isNotNull(), F.col("step"))).alias("seconds"))


def read_markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """(table, row, cells): rows of the pipe tables of a text, tables and rows numbered from 0; rulers are left out.

    A document is one row here, so it is read whole.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    marked = lines.withColumn("is_row", F.trim("line").startswith("|"))
    w = Window.partitionBy(F.lit(0)).orderBy("at")  # one document
    numbered = marked.withColumn("_new", (F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False))).cast("int")).withColumn("table", F.sum("_new").over(w) - 1)
    rows = numbered.where(F.col("is_row") & ~F.trim("line").rlike(r"^\|[\s:|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("table", (F.row_number().over(Window.partitionBy("table").orderBy("at")) - 1).alias("row"), cells.alias("cells"))


def read_programs(spark: SparkSession, path: str, family: str = "unknown", stage: str = "file") -> DataFrame:
    """(candidate_id, code, family, source_stage, path) of files of program text; the id is the text's hash."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("code"), F.col("_metadata.file_path").alias("path"))
    return files.select(F.substring(F.sha1(F.col("code").cast("binary")), 1, 12).alias("candidate_id"), "code", F.lit(family).alias("family"), F.lit(stage).alias("source_stage"), "path")


def parsed_objects(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``object``: the outermost JSON object within free text, or NULL."""
    return rows.withColumn("object", F.from_json(json_object(F.col(column)), schema))
