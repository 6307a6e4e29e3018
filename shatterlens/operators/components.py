"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shatterlens.operators.skew import lookup_join
from shatterlens.scratch import Scratch


def _stars(scratch: Scratch, edges: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star step over edges(u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = lookup_join(both.where(F.col("v") > F.col("u")), least, ["u"], 2 * total)
    large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct()
    large = scratch.save(large, "large")
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = lookup_join(large, low, ["u"], total)
    small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = scratch.save(small.where(F.col("u") > F.col("v")).distinct(), "small")
    scratch.drop(large)
    return out


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge; the component is its least node.

    The rounds grow with the logarithm of the longest path. A node with very many edges is joined
    apart from the others. NULL ends, loops and repeated edges are dropped; a node with only loops does not come out.
    """
    scratch = Scratch(edges.sparkSession)
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = scratch.save(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        n, seal = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, seal) == mark or not n:
            break
        mark, old = (n, seal), e
        e = _stars(scratch, old, n)
        scratch.drop(old)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
