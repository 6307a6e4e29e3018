"""Graphs as DataFrames: edges(graph, u, v) with u < v, and nodes(graph, node, ord).

All graphs are undirected and simple. ``ord`` is the place of a node's first appearance, from 1;
for graphs made from tables it is the place of the node in ascending order.
"""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shatterlens.operators.windows import numbered
from shatterlens.sources.tables import table


def simple_edges(pairs: DataFrame) -> DataFrame:
    """Undirected simple edges of pairs(graph, u, v): no loops, no repeats, no NULLs."""
    return pairs.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """nodes(graph, node, ord) in ascending order of the node."""
    ends = edges.select("graph", F.col("u").alias("node")).unionByName(edges.select("graph", F.col("v").alias("node"))).distinct()
    return numbered(ends, ["graph"], [F.asc("node")], "ord")


def read_edge_list(spark: SparkSession, path: str, graph: str, keep_loops: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a text file of two integers a line; other lines are skipped.

    The line's place orders the nodes: file, start of the split and place within it, which holds
    however the file is split. ``keep_loops`` keeps nodes that have only loops.
    """
    parts = F.split(F.trim("value"), r"\s+")
    text = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    pairs = text.select(F.lit(graph).alias("graph"), parts[0].try_cast("bigint").alias("u"), parts[1].try_cast("bigint").alias("v"), F.struct("file_path", "file_block_start", "id").alias("line")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    if not keep_loops:
        pairs = pairs.where(F.col("u") != F.col("v"))
    ends = pairs.select("graph", "line", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("node")), F.struct(F.lit(1).alias("side"), F.col("v").alias("node")))))
    first = ends.groupBy("graph", "node").agg(F.min(F.struct("line", "side")).alias("at"))
    nodes = numbered(first, ["graph"], [F.asc("at")], "ord").select("graph", "node", "ord")
    return simple_edges(pairs), nodes


def find_edge_list(root: str, name: str) -> str:
    """Path of a named graph below ``root``; FileNotFoundError if there is none."""
    for candidate in (f"{name}.txt", f"network/{name}.edgelist", f"{name}.edgelist"):
        if (Path(root) / candidate).exists():
            return str(Path(root) / candidate)
    raise FileNotFoundError(f"no edge list of {name} below {root}")


def read_node_link(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a JSON list of graphs {nodes, edges or links}; graphs are named by their place from 0."""
    link = "array<struct<source:bigint,target:bigint>>"
    suite = spark.read.schema(f"nodes array<struct<id:bigint>>, edges {link}, links {link}").json(path, multiLine=True)
    numbered = suite.withColumn("graph", F.monotonically_increasing_id().cast("string"))  # one file is one partition
    pairs = numbered.select("graph", F.inline(F.coalesce("edges", "links"))).toDF("graph", "u", "v")
    return simple_edges(pairs)


def _stub_pairs(degree: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    stubs = np.repeat(np.arange(len(degree)), degree)
    rng.shuffle(stubs)
    pairs = stubs[: len(stubs) // 2 * 2].reshape(-1, 2)
    pairs = np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1)
    return np.unique(pairs, axis=0)


def _labels(n: int, pairs: np.ndarray) -> np.ndarray:
    """Least node of the component of each node."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def power_law_pairs(n: int, gamma: float = 2.5, least: int = 2, seed: int = 42, connect: str = "chain") -> np.ndarray:
    """Edges of a configuration-model graph with P(k) ~ k^-gamma.

    connect ``chain`` joins components one after the other by their first members, with degrees up
    to 4 sqrt(n); ``largest`` keeps the largest component, relabelled, with degrees up to n^(1/(gamma-1)).
    """
    rng = np.random.default_rng(seed)
    most = max(least + 1, int(4 * math.sqrt(n)) if connect == "chain" else int(n ** (1 / (gamma - 1))))
    k = np.arange(least, most + 1)
    p = k**-gamma
    degree = rng.choice(k, size=n, p=p / p.sum())
    degree[0] += degree.sum() % 2
    pairs = _stub_pairs(degree, rng)
    label = _labels(n, pairs)
    if connect == "chain":
        first = np.unique(label, return_index=True)[1]
        return np.unique(np.concatenate([pairs, np.stack([first[:-1], first[1:]], axis=1)]), axis=0)
    names, sizes = np.unique(label, return_counts=True)
    kept = np.flatnonzero(label == names[sizes.argmax()])
    inside = np.isin(pairs[:, 0], kept)
    return np.searchsorted(kept, pairs[inside])


def power_law_suite(count: int = 50, n: int = 500, gamma: float = 2.5, share: float = 0.85, tries: int = 10, seed: int = 42) -> list[np.ndarray]:
    """Edge lists of ``count`` graphs that keep at least ``share`` of ``n`` nodes; at most ``tries`` draws each, else ValueError."""
    out = []
    for i in range(count):
        for t in range(tries):
            pairs = power_law_pairs(n, gamma, seed=seed + i * tries + t, connect="largest")
            if len(pairs) and pairs.max() + 1 >= share * n:
                out.append(pairs)
                break
        else:
            raise ValueError(f"graph {i}: none of {tries} draws keeps {share:g} of {n} nodes")
    return out


def graph_frame(spark: SparkSession, graphs: dict[str, np.ndarray]) -> DataFrame:
    """edges(graph, u, v) of small edge arrays made on the driver."""
    parts = [pd.DataFrame({"graph": k, "u": v[:, 0], "v": v[:, 1]}) for k, v in graphs.items()]
    return simple_edges(spark.createDataFrame(pd.concat(parts, ignore_index=True), "graph string, u bigint, v bigint"))


def successors(df: DataFrame, group: str, order: list[str], block: Column, value: str) -> DataFrame:
    """(value, next): each row's value and that of the row after it in its group.

    Rows are chained within blocks (which rise with the order), and block ends to the head of the next block, so
    that a large group is never in one task.
    """
    rows = df.withColumn("_b", block)
    within = Window.partitionBy(group, "_b").orderBy(*order)
    rows = rows.select(group, "_b", value, F.lead(value).over(within).alias("next"), F.lead(F.lit(True)).over(within).isNull().alias("_last"))
    heads = df.withColumn("_b", block).groupBy(group, "_b").agg(F.min_by(value, F.struct(*order)).alias("head"))
    heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy(group).orderBy("_b"))).drop("head")
    ends = rows.where("_last").drop("next").join(heads, [group, "_b"]).select(value, F.col("after").alias("next"))
    return rows.where(~F.col("_last")).select(value, "next").unionByName(ends)


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier nations that trade returned lines of 50 or more."""
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50))
    joined = (
        lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return simple_edges(joined.select(F.lit("trade").alias("graph"), F.col("c_nationkey").cast("bigint").alias("u"), F.col("s_nationkey").cast("bigint").alias("v")))


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even) and suppliers (odd) of first returned lines."""
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1))
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return simple_edges(joined.select(F.lit("supply").alias("graph"), (F.col("o_custkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v")))


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (odd) and parts (even) of returned lines."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return simple_edges(lines.select(F.lit("parts").alias("graph"), (F.col("l_suppkey") * 2 + 1).alias("u"), (F.col("l_partkey") * 2).alias("v")))


def user_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that follow one another within an event type."""
    after = successors(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], F.to_date("ts"), "user_id")
    return simple_edges(after.select(F.lit("users").alias("graph"), F.col("user_id").alias("u"), F.col("next").alias("v")))
