"""Removal orders that a score of the whole graph fixes: (graph, method, step, node).

Scores are joins and aggregates; a window puts the nodes in order. The tie rule is part of each
method. Nodes without an edge are scored 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shatterlens.operators.topology import adjacency, clustering, common_neighbours, degrees, sphere
from shatterlens.operators.windows import numbered


def score_order(nodes: DataFrame, scores: DataFrame, method: str, ties: list[Column] | None = None) -> DataFrame:
    """Order by scores(graph, node, score) downwards, ties by smallest node unless given; unscored nodes follow in ``ord``."""
    joined = nodes.join(scores, ["graph", "node"], "left")
    by = [F.col("score").isNull().asc(), F.desc("score"), *(ties or [F.asc("node")]), F.asc("ord")]
    return numbered(joined, ["graph"], by, "step").select("graph", F.lit(method).alias("method"), "step", "node")


def complete_order(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """First appearance of each valid node of order(graph, method, step, node), then the missing nodes in ``ord``."""
    first = order.join(nodes.select("graph", "node"), ["graph", "node"], "left_semi").groupBy("graph", "method", "node").agg(F.min("step").alias("at"))
    methods = order.select("graph", "method").distinct()
    missing = nodes.join(methods, "graph").join(first, ["graph", "method", "node"], "left_anti")
    both = first.select("graph", "method", "node", F.lit(0).alias("late"), F.col("at").cast("long").alias("at")).unionByName(missing.select("graph", "method", "node", F.lit(1).alias("late"), F.col("ord").cast("long").alias("at")))
    return numbered(both, ["graph", "method"], [F.asc("late"), F.asc("at"), F.asc("node")], "step").select("graph", "method", "step", "node")


def budget(n: Column, rate: Column | float) -> Column:
    """Removals at a rate: n * rate, half to even, at least 1 and at most n."""
    return F.greatest(F.lit(1), F.least(n, F.rint(n * rate)).cast("int")).cast("int")


def degree_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """By degree; of equal degrees the largest label as text first."""
    return score_order(nodes, degrees(edges).withColumnRenamed("degree", "score"), "degree", [F.desc(F.col("node").cast("string"))])


def collective_influence(edges: DataFrame, radius: int = 2) -> DataFrame:
    """(graph, node, score): (d - 1) times the sum of d - 1 over the sphere of ``radius``; 0 for degree 1."""
    d = degrees(edges)
    far = sphere(edges, radius).join(d.select("graph", F.col("node").alias("other"), (F.col("degree") - 1).alias("w")), ["graph", "other"])
    mass = far.groupBy("graph", "node").agg(F.sum("w").alias("w"))
    return d.join(mass, ["graph", "node"], "left").select("graph", "node", ((F.col("degree") - 1) * F.coalesce("w", F.lit(0))).cast("double").alias("score"))


def cluster_rank(edges: DataFrame) -> DataFrame:
    """(graph, node, score): 10^-clustering times the sum of neighbours' degrees plus 1."""
    d = degrees(edges).select("graph", F.col("node").alias("dst"), "degree")
    pressure = adjacency(edges).join(d, ["graph", "dst"]).groupBy("graph", F.col("src").alias("node")).agg(F.sum(F.col("degree") + 1).alias("w"))
    return clustering(edges).join(pressure, ["graph", "node"]).select("graph", "node", (F.pow(F.lit(10.0), -F.col("clustering")) * F.col("w")).alias("score"))


def neighbour_distance(edges: DataFrame, kind: str = "ndc", communities: DataFrame | None = None, beta: float = 0.5) -> DataFrame:
    """(graph, node, score): mean over neighbours v of the neighbours that v lacks.

    ``ncdc`` multiplies by ``beta`` where both ends share a community(graph, node, community);
    ``ndjc`` also divides by the size of the union of both neighbourhoods.
    """
    d = degrees(edges)
    common = common_neighbours(edges)
    both = common.select("graph", F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other"), "common"), F.struct(F.col("v").alias("node"), F.col("u").alias("other"), "common"))))
    both = both.join(d, ["graph", "node"]).join(d.select("graph", F.col("node").alias("other"), F.col("degree").alias("d_other")), ["graph", "other"])
    term = (F.col("degree") - F.col("common")).cast("double")
    if kind != "ndc":
        if communities is None:
            raise ValueError(f"{kind} needs communities")
        side = lambda c, name: communities.select("graph", F.col("node").alias(c), F.col("community").alias(name))
        both = both.join(side("node", "c1"), ["graph", "node"]).join(side("other", "c2"), ["graph", "other"])
        term = F.when(F.col("c1") == F.col("c2"), term * beta).otherwise(term)
    if kind == "ndjc":
        term = term / (F.col("degree") + F.col("d_other") - F.col("common"))
    return both.groupBy("graph", "node").agg((F.sum(term) / F.count(F.lit(1))).alias("score"))
