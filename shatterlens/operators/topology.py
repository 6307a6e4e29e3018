"""Local structure of edges(graph, u, v): all joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shatterlens.operators.windows import numbered


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions, before a join that multiplies them.

    A table of few megabytes would be one partition, and the join of its wedges one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph, src, dst) in both directions."""
    ends = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return edges.select("graph", F.inline(ends))


def degrees(edges: DataFrame) -> DataFrame:
    """(graph, node, degree) of all nodes with an edge."""
    return adjacency(edges).groupBy("graph", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(graph, a, b, c), each triangle once.

    Edges point from the lower to the higher (degree, node), so no node has more than sqrt(2 m)
    edges out and a hub does not multiply its neighbours.
    """
    d = degrees(edges)
    rank = lambda side: d.select("graph", F.col("node").alias(side), F.struct("degree", "node").alias(f"r{side}"))
    ranked = edges.join(rank("u"), ["graph", "u"]).join(rank("v"), ["graph", "v"])
    up = F.col("ru") < F.col("rv")
    arcs = ranked.select("graph", F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y"), F.greatest("ru", "rv").alias("r"))
    first = spread(arcs.select("graph", "x", F.col("y").alias("a"), F.col("r").alias("ra")), "graph", "x")
    second = arcs.select("graph", "x", F.col("y").alias("b"), F.col("r").alias("rb"))
    wedges = first.join(second, ["graph", "x"]).where(F.col("ra") < F.col("rb")).select("graph", "x", "a", "b")
    closing = arcs.select("graph", F.col("x").alias("a"), F.col("y").alias("b"))
    return wedges.join(closing, ["graph", "a", "b"]).select("graph", F.col("x").alias("a"), F.col("a").alias("b"), F.col("b").alias("c"))


def _corners(t: DataFrame, pairs: bool) -> DataFrame:
    if not pairs:
        return t.select("graph", F.explode(F.array("a", "b", "c")).alias("node"))
    edge = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    return t.select("graph", F.inline(F.array(edge("a", "b"), edge("a", "c"), edge("b", "c"))))


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(graph, node, triangles) of all nodes with an edge."""
    counted = _corners(triangles(edges), pairs=False).groupBy("graph", "node").agg(F.count(F.lit(1)).alias("triangles"))
    return degrees(edges).join(counted, ["graph", "node"], "left").select("graph", "node", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(graph, u, v, common) of every edge: the number of triangles it is in."""
    counted = _corners(triangles(edges), pairs=True).groupBy("graph", "u", "v").agg(F.count(F.lit(1)).alias("common"))
    return edges.join(counted, ["graph", "u", "v"], "left").select("graph", "u", "v", F.coalesce("common", F.lit(0)).alias("common"))


def clustering(edges: DataFrame) -> DataFrame:
    """(graph, node, degree, triangles, clustering): 2 t / (d (d - 1)), 0 below degree 2."""
    both = degrees(edges).join(triangle_counts(edges), ["graph", "node"])
    pairs = F.col("degree") * (F.col("degree") - 1)
    return both.withColumn("clustering", F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.col("triangles") / pairs))


def local_bridges(edges: DataFrame) -> DataFrame:
    """(graph, u, v) of the edges whose ends share no neighbour."""
    return common_neighbours(edges).where(F.col("common") == 0).select("graph", "u", "v")


def bridge_counts(edges: DataFrame) -> DataFrame:
    """(graph, node, bridges): local bridges at each node that has one."""
    return adjacency(local_bridges(edges)).groupBy("graph", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("bridges"))


#: Neighbours of a middle node that one cell of a two-step join takes on either side.
CELL = 1000


def two_steps(ring: DataFrame, step: DataFrame, cell: int = CELL) -> DataFrame:
    """(graph, node, next): ring(graph, node, other) followed by an arc step(graph, src, dst) from ``other``.

    Both sides of a middle node of more than ``cell`` arcs are cut into blocks and meet cell by cell, so that no task
    makes the square of a hub's degree.
    """
    out_ = step.groupBy("graph", "src").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > cell)
    large = out_.select("graph", F.col("src").alias("other"), F.ceil(F.col("_d") / cell).cast("int").alias("_k"))
    left = spread(ring, "graph", "node").join(large, ["graph", "other"], "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    left = left.select("graph", "node", "other", F.pmod(F.xxhash64("node"), "_k").cast("int").alias("_a"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_b"))
    right = step.select("graph", F.col("src").alias("other"), F.col("dst").alias("next")).join(large, ["graph", "other"], "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    right = right.select("graph", "other", "next", F.pmod(F.xxhash64("next"), "_k").cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_a"))
    return left.join(right, ["graph", "other", "_a", "_b"]).select("graph", "node", "next")


def sphere(edges: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """(graph, node, other) at a shortest distance of exactly ``radius`` (1 or more)."""
    step = adjacency(edges)
    ring = step.select("graph", F.col("src").alias("node"), F.col("dst").alias("other"))
    seen = ring
    for _ in range(radius - 1):
        far = two_steps(ring, step, cell).where(F.col("node") != F.col("next")).select("graph", "node", F.col("next").alias("other")).distinct()
        ring = far.join(seen, ["graph", "node", "other"], "left_anti")
        seen = seen.unionByName(ring)
    return ring


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in kept(graph, node)."""
    side = lambda c: kept.select("graph", F.col("node").alias(c)).distinct()
    return edges.join(side("u"), ["graph", "u"], "left_semi").join(side("v"), ["graph", "v"], "left_semi").select("graph", "u", "v")


def graph_stats(edges: DataFrame) -> DataFrame:
    """(graph, nodes, edges, mean_degree, mean_clustering)."""
    c = clustering(edges).groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"), F.avg("clustering").alias("mean_clustering"))
    m = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    return c.join(m, "graph").select("graph", "nodes", "edges", (2.0 * F.col("edges") / F.col("nodes")).alias("mean_degree"), "mean_clustering")


def component_sizes(members: DataFrame) -> DataFrame:
    """(graph, component, size) of members(graph, node, component)."""
    return members.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(members: DataFrame) -> DataFrame:
    """(graph, node) of each graph's largest component; of equal ones the one with the larger least node."""
    best = component_sizes(members).groupBy("graph").agg(F.max_by("component", F.struct("size", "component")).alias("component"))
    return members.join(best, ["graph", "component"]).select("graph", "node")


def relabelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges over 0, 1, ... in the order of ``ord`` of nodes(graph, node, ord)."""
    at = lambda c, n: nodes.select("graph", F.col("node").alias(c), (F.col("ord") - 1).cast("bigint").alias(n))
    both = edges.join(at("u", "a"), ["graph", "u"]).join(at("v", "b"), ["graph", "v"])
    return both.select("graph", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def chained(members: DataFrame) -> DataFrame:
    """Edges (graph, u, v) that join each component's least node to that of the next one."""
    firsts = numbered(members.select("graph", "component").distinct(), ["graph"], [F.asc("component")], "at")
    after = firsts.select("graph", F.col("component").alias("v"), (F.col("at") - 1).alias("at"))
    return firsts.join(after, ["graph", "at"]).select("graph", F.col("component").alias("u"), "v")


def sampled_edges(edges: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` edges of each graph, drawn evenly by a seeded hash: a sampling operator, for drawings.

    Only edges whose hash is below about twice the share wanted are ordered; of a graph in which these are too few all are.
    """
    drawn = edges.withColumn("_h", F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    sizes = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("_m"))
    some = drawn.join(sizes, "graph").withColumn("_low", F.col("_h") * F.col("_m") < 2 * most + 100)
    short = some.groupBy("graph").agg((F.sum(F.col("_low").cast("int")) < F.least(F.lit(most), F.first("_m"))).alias("_all"))
    rows = some.join(short, "graph").where(F.col("_low") | F.col("_all"))
    place = F.row_number().over(Window.partitionBy("graph").orderBy("_h", "u", "v"))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).select("graph", "u", "v")
