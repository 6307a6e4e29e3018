"""Queries over graphs made from the tables: structure, removal orders, fragmentation curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shatterlens.operators import adaptive, fragmentation as fr, rounds, static_orders as so, topology as tp
from shatterlens.operators.components import connected_components
from shatterlens.scratch import Scratch
from shatterlens.sources import graphs

RATE = 0.30


def stored(edges: DataFrame) -> DataFrame:
    """The edges as a written table: every operator reads them several times."""
    return Scratch(edges.sparkSession).save(edges, "edges")


def local_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two graphs with triangles: trading nations and succeeding users."""
    return stored(graphs.nation_trade(spark, sf_dir).unionByName(graphs.user_succession(spark, sf_dir)))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer-supplier graph."""
    return stored(graphs.customer_supplier(spark, sf_dir))


def _all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(graphs.nation_trade(spark, sf_dir).unionByName(graphs.user_succession(spark, sf_dir)).unionByName(graphs.customer_supplier(spark, sf_dir)).unionByName(graphs.supplier_part(spark, sf_dir)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All DOUBLE columns rounded, so that two engines that add in another order agree."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def graph_sizes(spark, d):
    """Edges and label sums of all four graphs."""
    return _all_edges(spark, d).groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.sum("u").alias("sum_u"), F.sum("v").alias("sum_v"))


def graph_degree(spark, d):
    return tp.degrees(_all_edges(spark, d))


def graph_degree_histogram(spark, d):
    return tp.degrees(_all_edges(spark, d)).groupBy("graph", "degree").agg(F.count(F.lit(1)).alias("nodes"))


def graph_triangles(spark, d):
    return tp.triangle_counts(local_edges(spark, d))


def graph_clustering(spark, d):
    return rounded(tp.clustering(local_edges(spark, d)))


def graph_common_neighbours(spark, d):
    return tp.common_neighbours(local_edges(spark, d))


def graph_local_bridges(spark, d):
    return tp.bridge_counts(stored(graphs.nation_trade(spark, d).unionByName(graphs.user_succession(spark, d)).unionByName(graphs.customer_supplier(spark, d))))


def graph_sphere(spark, d):
    """Nodes at distance two."""
    edges = stored(graphs.nation_trade(spark, d).unionByName(graphs.customer_supplier(spark, d)))
    return tp.sphere(edges, 2).groupBy("graph", "node").agg(F.count(F.lit(1)).alias("at_two"))


def graph_stats(spark, d):
    return rounded(tp.graph_stats(local_edges(spark, d)))


def graph_components(spark, d):
    """Component of every node of the customer-supplier graph."""
    return connected_components(graphs.customer_supplier(spark, d), "u", "v")


def _left(edges, rate):
    """Edges left after the degree order's removals at a rate."""
    nodes = graphs.nodes_of(edges)
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    return tp.induced(edges, so.degree_order(edges, nodes).join(n, "graph").where(F.col("step") > so.budget(F.col("n"), rate)))


def graph_residual(spark, d):
    """Edges left of all four graphs after the degree order's removals at a twentieth of the nodes."""
    return _left(_all_edges(spark, d), 0.05)


def graph_user_successors(spark, d):
    from shatterlens.sources.tables import table

    after = graphs.successors(table(spark, d, "events"), "event_type", ["ts", "event_id"], F.to_date("ts"), "event_id")
    return after.select("event_id", F.coalesce("next", F.lit(-1)).alias("next_event_id"))


def graph_core_numbers(spark, d):
    edges = stored(graphs.nation_trade(spark, d).unionByName(graphs.customer_supplier(spark, d)))
    return rounds.core_numbers(edges).withColumnRenamed("value", "core")


def graph_largest_pieces(spark, d):
    """What every articulation point of trading nations, succeeding users and the customer-supplier graph's residual leaves at most."""
    edges = stored(local_edges(spark, d).unionByName(_left(supply_edges(spark, d), 0.05)))
    return adaptive.largest_pieces(edges, graphs.nodes_of(edges))


def graph_communities(spark, d):
    edges = local_edges(spark, d)
    return rounds.communities(edges).withColumnRenamed("value", "community")


def _static(name: str, scores: Callable[[DataFrame], DataFrame], edges_of=local_edges):
    def query(spark, d):
        edges = edges_of(spark, d)
        found = scores(edges).withColumn("score", F.round("score", 6))
        return so.score_order(graphs.nodes_of(edges), found, name)

    query.__doc__ = f"Removal order by {name}."
    return query


def order_degree(spark, d):
    edges = _all_edges(spark, d)
    return so.degree_order(edges, graphs.nodes_of(edges))


def order_core(spark, d):
    """By core number, then degree, then the largest label."""
    edges = stored(graphs.nation_trade(spark, d).unionByName(graphs.customer_supplier(spark, d)))
    nodes = graphs.nodes_of(edges)
    scores = rounds.core_numbers(edges).withColumnRenamed("value", "score").join(tp.degrees(edges), ["graph", "node"])
    return so.score_order(nodes, scores, "core", [F.desc("degree"), F.desc("node")])


def _by_community(kind: str):
    def query(spark, d):
        edges = local_edges(spark, d)
        nodes = graphs.nodes_of(edges)
        parts = rounds.communities(edges).withColumnRenamed("value", "community")
        return so.score_order(nodes, so.neighbour_distance(edges, kind, parts), kind)

    query.__doc__ = f"Removal order by {kind}, which counts shared communities."
    return query


def order_betweenness(spark, d):
    edges = stored(graphs.nation_trade(spark, d).unionByName(graphs.customer_supplier(spark, d)))
    nodes = graphs.nodes_of(edges)
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = F.col("score") * (F.col("n") - 1) * (F.col("n") - 2)  # normalised scores of large graphs are too small to be rounded
    return so.score_order(nodes, adaptive.betweenness(edges, nodes).join(n, "graph").select("graph", "node", F.round(pairs, 6).alias("score")), "betweenness")


def _with_methods(spark, d, *names):
    edges = stored(graphs.nation_trade(spark, d).unionByName(graphs.customer_supplier(spark, d)))
    return adaptive.adaptive_orders(edges, graphs.nodes_of(edges), {k: adaptive.METHODS[k] for k in names}, RATE)


def _adaptive_graphs(spark, d):
    edges = stored(graphs.nation_trade(spark, d).unionByName(graphs.customer_supplier(spark, d)))
    return edges, graphs.nodes_of(edges)


def _stored_states(spark, edges, nodes, orders):
    """Trajectories as a written table; they and the orders are read several times."""
    scratch = Scratch(spark)
    return scratch.save(fr.trajectories(edges, nodes, scratch.save(orders, "orders"), RATE), "states")


def _adaptive_summaries(spark, d):
    edges, nodes = _adaptive_graphs(spark, d)
    states = Scratch(spark).save(adaptive.adaptive_states(edges, nodes, adaptive.METHODS, RATE), "states")
    return fr.summaries(fr.with_metrics(states))


def order_adaptive(spark, d):
    """All adaptive methods."""
    return adaptive.adaptive_orders(*_adaptive_graphs(spark, d), adaptive.METHODS, RATE)


def order_proxies(spark, d):
    """Four programs of the proxy family on trading nations."""
    edges = stored(graphs.nation_trade(spark, d))
    chosen = [p for g in ("R/GCC-only", "Relative-Free", "CostAware-Free", "Bounded-Guided") for p in adaptive.proxies(g, 1)]
    methods = {p.group: (lambda g, k, p=p: adaptive.proxy_order(g, k, p)) for p in chosen}
    return adaptive.adaptive_orders(edges, graphs.nodes_of(edges), methods, RATE)


def order_highest_degree(spark, d):
    """The tie rules of highest residual degree, and the blend of degrees alone, on trading nations and the customer-supplier graph."""
    return _with_methods(spark, d, "hda_original", "hda_fast", "hda_number", "blend_root")


def order_core_first(spark, d):
    """The two methods that take the 2-core first, on the same graphs."""
    return _with_methods(spark, d, "corehd_original", "corehd_fast")


def order_completed(spark, d):
    """A partial order with repeats and strangers, completed."""
    edges = supply_edges(spark, d)
    nodes = graphs.nodes_of(edges)
    listed = tp.degrees(edges).where("degree >= 3").select("graph", F.lit("listed").alias("method"), (F.col("node") % 97).alias("step"), "node")
    listed = listed.unionByName(listed.withColumn("step", F.col("step") + 50)).unionByName(listed.withColumn("node", -F.col("node") - 1))
    order = listed.withColumn("step", F.col("step") * 1_000_000 + F.col("node"))
    return so.complete_order(nodes, order)


def _degree_states(spark, d):
    edges = supply_edges(spark, d)
    nodes = graphs.nodes_of(edges)
    return fr.trajectories(edges, nodes, so.degree_order(edges, nodes), RATE)


def curve_states(spark, d):
    return _degree_states(spark, d).select("graph", "step", "n", "left", "largest", "ncc", "top5", "squares")


def curve_metrics(spark, d):
    return rounded(fr.with_metrics(_degree_states(spark, d)).select("graph", "step", "gcc", "ncc", "top5_mass", "hhi", "ec", "pd", "cnbi"))


def curve_running(spark, d):
    return rounded(fr.with_running(fr.with_metrics(_degree_states(spark, d))).select("graph", "step", "running_r", "running_cnbi"))


def _two_orders(spark, d):
    edges = supply_edges(spark, d)
    nodes = graphs.nodes_of(edges)
    orders = so.degree_order(edges, nodes).unionByName(so.score_order(nodes, so.collective_influence(edges), "ci"))
    return _stored_states(spark, edges, nodes, orders)


def curve_summary(spark, d):
    out = fr.summaries(fr.with_metrics(_two_orders(spark, d)))
    return rounded(out)


def curve_advantage(spark, d):
    """Gain of collective influence over degree."""
    return rounded(fr.fracture_advantage(fr.summaries(fr.with_metrics(_two_orders(spark, d))), "degree"))


def curve_residual_means(spark, d):
    return rounded(fr.plain_means(fr.with_metrics(_two_orders(spark, d), "residual")))


def curve_paper_variant(spark, d):
    return rounded(fr.with_metrics(_two_orders(spark, d), "paper").select("graph", "method", "step", "pd", "cnbi"))


def curve_area_floor(spark, d):
    """Areas over a span that counts as at least a half."""
    return rounded(fr.normalised_area(fr.with_metrics(_two_orders(spark, d)), ["graph", "method"], "removal_ratio", ["gcc", "cnbi"], floor=0.5))


def curve_value_at(spark, d):
    return rounded(fr.value_at(fr.with_metrics(_two_orders(spark, d)), "cnbi", 0.2))


def curve_forest(spark, d):
    """The same states from a distributed spanning forest of the large graph's edges."""
    edges = supply_edges(spark, d)
    nodes = graphs.nodes_of(edges)
    orders = so.degree_order(edges, nodes)
    forest = fr.spanning_forest(fr.positioned(edges, orders))
    at = orders.select("graph", "method", F.col("step"), "node")
    kept = forest.join(at.withColumnsRenamed({"step": "lo", "node": "a"}), ["graph", "method", "lo"]).join(at.withColumnsRenamed({"step": "hi", "node": "b"}), ["graph", "method", "hi"])
    few = kept.select("graph", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return fr.trajectories(few, nodes, orders, RATE).select("graph", "step", "n", "left", "largest", "ncc", "top5", "squares")


def curve_component_states(spark, d):
    """State of the whole graphs from component sizes, by aggregation alone."""
    parts = connected_components(graphs.customer_supplier(spark, d), "u", "v").groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    n = parts.agg(F.sum("size").alias("n"))
    sizes = parts.crossJoin(F.broadcast(n)).select(F.lit("supply").alias("graph"), F.lit("none").alias("method"), F.lit(0).alias("step"), "n", "size")
    return fr.states_by_components(sizes)


def curve_adaptive(spark, d):
    """Summaries of all adaptive methods."""
    return rounded(_adaptive_summaries(spark, d))


def curve_mean_over_graphs(spark, d):
    """Means over graphs of all adaptive methods' summaries."""
    return rounded(fr.mean_over_graphs(_adaptive_summaries(spark, d)))


def order_timed(spark, d):
    """Steps and errors of a run in which one method fails; times are left out."""
    edges = stored(graphs.nation_trade(spark, d))
    methods = {"hda_fast": adaptive.METHODS["hda_fast"], "broken": lambda g, k: [g.labels[-1] // 0]}
    timed = adaptive.adaptive_orders(edges, graphs.nodes_of(edges), methods, RATE, timed=True)
    return timed.groupBy("graph", "method").agg(F.max("step").alias("steps"), F.max("error").alias("error"))


def _members(edges):
    found = connected_components(edges, "u", "v")
    return found.select(F.lit("supply").alias("graph"), "node", "component")


def graph_largest_component(spark, d):
    """The largest component, relabelled from 0 in the order of its nodes."""
    edges = stored(graphs.customer_supplier(spark, d))
    kept = tp.induced(edges, tp.largest_component(_members(edges)))
    return tp.relabelled(kept, graphs.nodes_of(kept))


def graph_chain(spark, d):
    """Edges that would join the components left of the customer-supplier graph, after removals at 0.07 of its nodes, one after the other."""
    return tp.chained(_members(stored(_left(supply_edges(spark, d), 0.07))))


def graph_edge_sample(spark, d):
    """At most 1600 edges of each graph; a sampling operator."""
    return tp.sampled_edges(_all_edges(spark, d), 1600).groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))


def study_validation(spark, d):
    """Methods over graphs, one of which fails: means and gate."""
    from shatterlens.plans import studies

    edges, nodes = _adaptive_graphs(spark, d)
    methods = {k: adaptive.METHODS[k] for k in ("hda_original", "corehd_fast", "decycling")} | {"broken": lambda g, k: [len(g) // 0]}
    refs = spark.createDataFrame([("q", 0.5, 0.9, None)], "label string, ref_auc_cnbi double, ref_r double, ref_time_s double")
    _, means, gated = studies.validation(edges, nodes, methods, RATE, refs)
    return rounded(means.drop("mean_time_s").join(gated.select("method", "passes"), "method"))


def study_search(spark, d):
    """A short search over score blends on trading nations."""
    from shatterlens.plans import studies

    edges = stored(graphs.nation_trade(spark, d))
    found = studies.search(edges, graphs.nodes_of(edges), rounds=2, width=3)
    return spark.createDataFrame(found[["node_id", "parent_id", "r", "cnbi", "score", "valid"]], "node_id string, parent_id string, r double, cnbi double, score double, valid boolean")


_plain = [
    graph_largest_component, graph_chain, graph_edge_sample, study_validation, study_search,
    graph_sizes, graph_degree, graph_degree_histogram, graph_triangles, graph_clustering, graph_common_neighbours, graph_local_bridges, graph_sphere, graph_stats, graph_components,
    graph_residual, graph_user_successors, graph_core_numbers, graph_largest_pieces, graph_communities, order_degree, order_core, order_betweenness, order_adaptive, order_proxies, order_highest_degree, order_core_first,
    order_completed, order_timed, curve_states, curve_metrics, curve_running, curve_summary, curve_advantage, curve_residual_means, curve_paper_variant, curve_area_floor, curve_value_at, curve_forest,
    curve_component_states, curve_adaptive, curve_mean_over_graphs,
]
QUERIES = {f.__name__: f for f in _plain} | {
    "order_collective_influence": _static("ci", so.collective_influence), "order_cluster_rank": _static("cluster_rank", so.cluster_rank), "order_neighbour_distance": _static("ndc", so.neighbour_distance),
    "order_ncdc": _by_community("ncdc"), "order_ndjc": _by_community("ndjc"),
}
_TRADE = """SELECT DISTINCT 'trade' AS graph, CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS u, CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_returnflag = 'R' AND l_quantity >= 50 AND c_nationkey <> s_nationkey"""
_USERS = """SELECT DISTINCT 'users' AS graph, least(user_id, nxt) AS u, greatest(user_id, nxt) AS v
    FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events) WHERE user_id <> nxt"""
_SUPPLY = """SELECT DISTINCT 'supply' AS graph, least(o_custkey * 2, l_suppkey * 2 + 1) AS u, greatest(o_custkey * 2, l_suppkey * 2 + 1) AS v
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linenumber = 1"""
_PARTS = "SELECT DISTINCT 'parts' AS graph, least(l_suppkey * 2 + 1, l_partkey * 2) AS u, greatest(l_suppkey * 2 + 1, l_partkey * 2) AS v FROM lineitem WHERE l_returnflag = 'R'"


def _over(*sources: str) -> str:
    return (
        "WITH RECURSIVE edges AS (" + " UNION ALL ".join(sources) + "), adj AS (SELECT graph, u AS src, v AS dst FROM edges UNION ALL SELECT graph, v, u FROM edges), "
        "deg AS (SELECT graph, src AS node, count(*) AS degree FROM adj GROUP BY ALL), "
        "com AS (SELECT e.graph, e.u, e.v, count(b.dst) AS common FROM edges e LEFT JOIN adj a ON a.graph = e.graph AND a.src = e.u LEFT JOIN adj b ON b.graph = e.graph AND b.src = e.v AND b.dst = a.dst GROUP BY ALL), "
        "two AS (SELECT DISTINCT a.graph, a.src AS node, b.dst AS other FROM adj a JOIN adj b ON a.graph = b.graph AND a.dst = b.src AND b.dst <> a.src ANTI JOIN adj c ON c.graph = a.graph AND c.src = a.src AND c.dst = b.dst) "
    )


_ALL, _LOCAL, _ON_SUPPLY = _over(_TRADE, _USERS, _SUPPLY, _PARTS), _over(_TRADE, _USERS), _over(_SUPPLY)
_TRI = ", tri AS (SELECT graph, node, CAST(sum(common) / 2 AS BIGINT) AS triangles FROM (SELECT graph, u AS node, common FROM com UNION ALL SELECT graph, v, common FROM com) GROUP BY ALL) "
_CLU = _TRI + ", clu AS (SELECT graph, node, degree, triangles, CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * triangles / (degree * (degree - 1)) END AS clustering FROM deg JOIN tri USING (graph, node)) "
_CI = ", ci AS (SELECT d.graph, d.node, CAST((d.degree - 1) * coalesce(sum(o.degree - 1), 0) AS DOUBLE) AS score FROM deg d LEFT JOIN two t ON t.graph = d.graph AND t.node = d.node LEFT JOIN deg o ON o.graph = t.graph AND o.node = t.other GROUP BY d.graph, d.node, d.degree) "
_DEGREE_ORDER = "SELECT graph, 'degree' AS method, CAST(row_number() OVER (PARTITION BY graph ORDER BY degree DESC, CAST(node AS VARCHAR) DESC) AS INTEGER) AS step, node FROM deg"


def _order(name: str, scores: str) -> str:
    return f"SELECT graph, '{name}' AS method, CAST(row_number() OVER (PARTITION BY graph ORDER BY round(score, 6) DESC, node) AS INTEGER) AS step, node FROM ({scores})"


def _curve(orders: str) -> str:
    """States of orders(graph, method, step, node): from the last step to the first, each node comes back and takes its neighbours' components with it.

    part(method, k, node, label) holds, after k removals, the label of every node left; the row of node -1 keeps the recursion going.
    """
    return (
        f", orders AS MATERIALIZED ({orders}), cnt AS (SELECT count(*) AS n, CAST(greatest(1, least(count(*), round_even(CAST(count(*) AS DOUBLE) * 0.3, 0))) AS INTEGER) AS most FROM deg), "
        "lab AS (SELECT method, CAST(max(step) AS INTEGER) AS k, CAST(-1 AS BIGINT) AS node, CAST(-1 AS BIGINT) AS label FROM orders GROUP BY method UNION ALL ("
        "WITH hit AS (SELECT l.method, l.label, min(l.label) OVER (PARTITION BY l.method) AS low FROM lab l JOIN orders o ON o.method = l.method AND o.step = l.k JOIN adj a ON a.src = o.node AND a.dst = l.node GROUP BY l.method, l.label) "
        "SELECT l.method, l.k - 1, l.node, CASE WHEN h.label IS NULL THEN l.label ELSE least(h.low, o.node) END FROM lab l JOIN orders o ON o.method = l.method AND o.step = l.k LEFT JOIN hit h ON h.method = l.method AND h.label = l.label "
        "UNION ALL SELECT o.method, o.step - 1, o.node, least(o.node, coalesce((SELECT min(h.low) FROM hit h WHERE h.method = o.method), o.node)) FROM lab l JOIN orders o ON o.method = l.method AND o.step = l.k WHERE l.node = -1)), "
        "part AS (SELECT method, k, label, count(*) AS size FROM lab, cnt WHERE node <> -1 AND k BETWEEN 1 AND most GROUP BY ALL), "
        "st AS (SELECT 'supply' AS graph, method, CAST(k AS INTEGER) AS step, k / CAST(n AS DOUBLE) AS ratio, n, n - k AS rest, max(size) AS largest, count(*) AS ncc, CAST(list_sum(list_slice(list_reverse_sort(list(size)), 1, 5)) AS BIGINT) AS top5, CAST(sum(size * size) AS BIGINT) AS squares FROM part, cnt GROUP BY method, k, n), "
        "m0 AS (SELECT *, largest / CAST(n AS DOUBLE) AS gcc, squares / pow(CAST(greatest(1, rest) AS DOUBLE), 2) AS hhi, greatest(0.0, CASE WHEN rest <= 1 THEN 1.0 ELSE 1 - (squares - rest) / CAST(rest * (rest - 1) AS DOUBLE) END) AS pd_left FROM st), "
        "m AS (SELECT *, top5 / CAST(n AS DOUBLE) AS top5_mass, 1 / hhi AS ec, 1 - (squares - rest) / CAST(greatest(1, n * (n - 1)) AS DOUBLE) AS pd FROM m0), "
        "met AS (SELECT *, pd * ec / (1 + top5_mass) AS cnbi, pd_left * ec / (1 + top5_mass) AS cnbi_paper, pd_left * ec / (1 + top5 / CAST(greatest(1, rest) AS DOUBLE)) AS cnbi_left FROM m), "
        "seg AS (SELECT *, ratio - lag(ratio) OVER w AS dx, (gcc + lag(gcc) OVER w) / 2 AS yg, (ncc + lag(ncc) OVER w) / 2.0 AS yn, (cnbi + lag(cnbi) OVER w) / 2 AS yc FROM met WINDOW w AS (PARTITION BY method ORDER BY step)), "
        "summ AS (SELECT graph, method, count(*) AS steps, avg(gcc) AS r, "
        + ", ".join(f"CAST(arg_max({c}, step) AS DOUBLE) AS final_{c}" for c in ("gcc", "ncc", "cnbi")) + ", "
        + ", ".join(f"CAST(arg_min({c}, (abs(ratio - 0.2), step)) AS DOUBLE) AS early_{c}" for c in ("gcc", "ncc", "cnbi"))
        + ", sum(dx * yg) / (max(ratio) - min(ratio)) AS auc_acc, sum(dx * yn) / (max(ratio) - min(ratio)) AS auc_ncc, sum(dx * yc) / (max(ratio) - min(ratio)) AS auc_cnbi FROM seg GROUP BY graph, method) "
    )


_ONE = _ON_SUPPLY + _curve(_DEGREE_ORDER)
_BOTH = _ON_SUPPLY + _CI + _curve(_DEGREE_ORDER + " UNION ALL " + _order("ci", "SELECT * FROM ci"))
_STATES = _ONE + "SELECT graph, step, n, rest AS \"left\", largest, ncc, top5, squares FROM st"
_SUMMARY = ["r", *[f"{a}_{c}" for a in ("final", "early") for c in ("gcc", "ncc", "cnbi")], "auc_acc", "auc_ncc", "auc_cnbi"]


_LEFT = f", o AS ({_DEGREE_ORDER}), sizes AS (SELECT graph, count(*) AS n FROM deg GROUP BY graph), gone AS (SELECT graph, node FROM o JOIN sizes USING (graph) WHERE step <= greatest(1, least(n, round_even(CAST(n AS DOUBLE) * {{rate}}, 0)))), rest AS (SELECT graph, u, v FROM edges e ANTI JOIN gone x ON x.graph = e.graph AND x.node = e.u ANTI JOIN gone y ON y.graph = e.graph AND y.node = e.v) "
_TIES = (("hda_original", "CAST(node AS VARCHAR) DESC"), ("hda_fast", "CAST(node AS VARCHAR)"), ("hda_number", "node DESC"), ("blend_root", "node"))
_BUDGETS = ", cap AS (SELECT graph, CAST(greatest(1, least(count(*), round_even(CAST(count(*) AS DOUBLE) * 0.3, 0))) AS INTEGER) AS most FROM deg GROUP BY graph)"


def _removals(states: str) -> str:
    """Orders of picks(graph, method, step, node), each completed by the nodes left in ascending order."""
    return states + (
        ", methods AS (SELECT DISTINCT graph, method FROM picks), left_over AS (SELECT m.graph, m.method, d.node FROM methods m JOIN deg d USING (graph) ANTI JOIN picks p ON p.graph = m.graph AND p.method = m.method AND p.node = d.node) "
        "SELECT graph, method, CAST(step AS INTEGER) AS step, node FROM picks UNION ALL SELECT graph, method, CAST(most + row_number() OVER (PARTITION BY graph, method ORDER BY node) AS INTEGER), node FROM left_over JOIN cap USING (graph)"
    )


def _highest_degree() -> str:
    """h: nodes left after ``step`` removals with their degrees; best: the places of the methods' ties; pick: the next one to go."""
    best = " UNION ALL ".join(f"SELECT graph, '{m}' AS method, node, row_number() OVER (PARTITION BY graph ORDER BY {tie}) AS tie FROM deg" for m, tie in _TIES)
    pick = "first_value(node) OVER (PARTITION BY graph, method ORDER BY degree DESC, tie)"
    return _removals(
        _over(_TRADE, _SUPPLY) + _BUDGETS + f", best AS MATERIALIZED ({best}), "
        f"h AS (SELECT graph, method, 0 AS step, node, tie, degree, {pick} AS pick FROM best JOIN deg USING (graph, node) UNION ALL "
        f"SELECT graph, method, step + 1, node, tie, degree, {pick} FROM (SELECT h.graph, h.method, h.step, h.node, h.tie, h.degree - (a.dst IS NOT NULL)::INT AS degree FROM h JOIN cap ON cap.graph = h.graph LEFT JOIN adj a ON a.graph = h.graph AND a.src = h.pick AND a.dst = h.node WHERE h.node <> h.pick AND h.step + 1 < most)), "
        "picks AS (SELECT DISTINCT graph, method, step + 1 AS step, pick AS node FROM h)"
    )


def _core_first() -> str:
    """c: nodes left with their degree, their degree within the 2-core and whether they are in it; a round peels all core nodes below degree 2, or else removes one node."""
    best = (
        "SELECT graph, 'corehd_original' AS method, node, row_number() OVER (PARTITION BY graph ORDER BY node DESC) AS tie FROM deg UNION ALL "
        "SELECT graph, 'corehd_fast', node, row_number() OVER (PARTITION BY graph ORDER BY CAST(node AS VARCHAR)) FROM deg"
    )
    value = "CASE WHEN core AND method = 'corehd_original' THEN inner_degree ELSE degree END"
    turn = (
        "bool_or(core AND inner_degree < 2) OVER (PARTITION BY graph, method) AS peels, "
        f"first_value(node) OVER (PARTITION BY graph, method ORDER BY core DESC, {value} DESC, tie) AS pick"
    )
    return _removals(
        _over(_TRADE, _SUPPLY) + _BUDGETS + f", best AS MATERIALIZED ({best}), "
        f"c AS (SELECT *, {turn} FROM (SELECT graph, method, 0 AS step, node, tie, degree, degree AS inner_degree, true AS core FROM best JOIN deg USING (graph, node)) UNION ALL ("
        "WITH gone AS (SELECT graph, method, node, core FROM c WHERE CASE WHEN peels THEN core AND inner_degree < 2 ELSE node = pick END), "
        "hit AS (SELECT g.graph, g.method, a.dst AS node, count(*) AS n, count(*) FILTER (WHERE g.core) AS inner_n FROM gone g JOIN adj a ON a.graph = g.graph AND a.src = g.node GROUP BY ALL) "
        f"SELECT *, {turn} FROM (SELECT c.graph, c.method, c.step + (NOT c.peels)::INT AS step, c.node, c.tie, c.degree - CASE WHEN c.peels THEN 0 ELSE coalesce(h.n, 0) END AS degree, c.inner_degree - coalesce(h.inner_n, 0) AS inner_degree, c.core AND NOT (c.peels AND c.inner_degree < 2) AS core "
        "FROM c JOIN cap ON cap.graph = c.graph LEFT JOIN hit h ON h.graph = c.graph AND h.method = c.method AND h.node = c.node WHERE (c.peels OR c.node <> c.pick) AND c.step + (NOT c.peels)::INT < most))), "
        "picks AS (SELECT DISTINCT graph, method, step + 1 AS step, pick AS node FROM c WHERE NOT peels)"
    )


#: p: labels of every node, round by round, with the one that it wishes for; com_of: those of the last round.
_LABELS = (
    ", p AS (SELECT graph, node, node AS label, 0 AS turn, true AS moving FROM deg UNION ALL ("
    "WITH votes AS (SELECT a.graph, a.src AS node, x.label AS vote, count(*) AS n FROM adj a JOIN p x ON x.graph = a.graph AND x.node = a.dst GROUP BY ALL), "
    "best AS (SELECT v.graph, v.node, arg_max(v.vote, (v.n, v.vote)) AS vote, max(v.n) AS n, coalesce(max(v.n) FILTER (WHERE v.vote = x.label), 0) AS own FROM votes v JOIN p x ON x.graph = v.graph AND x.node = v.node GROUP BY ALL), "
    "wish AS (SELECT graph, bool_or(n > own) AS moving FROM best GROUP BY graph) "
    "SELECT x.graph, x.node, CASE WHEN b.n > b.own AND CAST('0x' || left(md5(x.node || '|' || x.turn), 1) AS INTEGER) % 2 = 0 THEN b.vote ELSE x.label END, x.turn + 1, w.moving "
    "FROM p x JOIN best b ON b.graph = x.graph AND b.node = x.node JOIN wish w ON w.graph = x.graph WHERE x.moving)), "
    "com_of AS (SELECT graph, node, label FROM p WHERE NOT moving) "
)
_DISTANCES = "WITH near AS (SELECT d.graph, d.node, d.degree - e.common AS lack, d.degree + o.degree - e.common AS both_size, x.label = y.label AS same FROM deg d JOIN (SELECT graph, u AS node, v AS other, common FROM com UNION ALL SELECT graph, v, u, common FROM com) e USING (graph, node) JOIN deg o ON o.graph = e.graph AND o.node = e.other JOIN com_of x ON x.graph = d.graph AND x.node = d.node JOIN com_of y ON y.graph = d.graph AND y.node = e.other) "
#: k: nodes not yet peeled with their degrees; a round takes all up to the level away, or else raises the level.
_CORES = (
    ", k AS (SELECT graph, node, degree, CAST(0 AS BIGINT) AS level, false AS gone FROM deg UNION ALL ("
    "WITH now AS (SELECT graph, level, bool_or(degree <= level) AS peels FROM k WHERE NOT gone GROUP BY ALL), "
    "hit AS (SELECT x.graph, a.dst AS node, count(*) AS n FROM k x JOIN adj a ON a.graph = x.graph AND a.src = x.node WHERE NOT x.gone AND x.degree <= x.level GROUP BY ALL) "
    "SELECT k.graph, k.node, k.degree - coalesce(h.n, 0), k.level + (NOT w.peels)::INT, k.degree <= k.level FROM k JOIN now w ON w.graph = k.graph LEFT JOIN hit h ON h.graph = k.graph AND h.node = k.node WHERE NOT k.gone)), "
    "core AS (SELECT graph, node, level AS core FROM k WHERE gone) "
)
#: b: distance and number of shortest paths from every node to every other; back: shares of paths, level by level from the farthest.
_BETWEEN = (
    ", b AS (SELECT graph, node AS src, node, 0 AS dist, CAST(1 AS DOUBLE) AS paths, true AS fresh FROM deg UNION ALL ("
    "WITH far AS (SELECT x.graph, x.src, a.dst AS node, x.dist + 1 AS dist, sum(x.paths) AS paths FROM b x JOIN adj a ON a.graph = x.graph AND a.src = x.node WHERE x.fresh GROUP BY ALL), "
    "new AS (SELECT f.* FROM far f ANTI JOIN b ON b.graph = f.graph AND b.src = f.src AND b.node = f.node) "
    "SELECT graph, src, node, dist, paths, true FROM new UNION ALL SELECT graph, src, node, dist, paths, false FROM b WHERE fresh AND EXISTS (SELECT 1 FROM new))), "
    "reach AS MATERIALIZED (SELECT graph, src, node, dist, paths FROM b WHERE fresh), "
    "back AS (SELECT graph, src, node, dist, paths, CAST(0 AS DOUBLE) AS share, (SELECT max(dist) FROM reach) AS level FROM reach WHERE dist = (SELECT max(dist) FROM reach) UNION ALL ("
    "WITH part AS (SELECT x.graph, x.src, a.dst AS node, sum((1 + x.share) / x.paths) AS w FROM back x JOIN adj a ON a.graph = x.graph AND a.src = x.node GROUP BY ALL), down AS (SELECT max(level) - 1 AS level FROM back) "
    "SELECT r.graph, r.src, r.node, r.dist, r.paths, r.paths * coalesce(p.w, 0), r.dist FROM reach r JOIN down ON r.dist = down.level LEFT JOIN part p ON p.graph = r.graph AND p.src = r.src AND p.node = r.node WHERE down.level > 0)), "
    "between AS (SELECT d.graph, d.node, coalesce(sum(x.share), 0) AS score FROM deg d LEFT JOIN back x ON x.graph = d.graph AND x.node = d.node AND x.src <> d.node GROUP BY ALL) "
)

ORACLES = {
    "graph_sizes": _ALL + "SELECT graph, count(*) AS edges, CAST(sum(u) AS BIGINT) AS sum_u, CAST(sum(v) AS BIGINT) AS sum_v FROM edges GROUP BY graph",
    "graph_degree": _ALL + "SELECT graph, node, degree FROM deg",
    "graph_degree_histogram": _ALL + "SELECT graph, degree, count(*) AS nodes FROM deg GROUP BY ALL",
    "graph_triangles": _LOCAL + _TRI + "SELECT * FROM tri",
    "graph_clustering": _LOCAL + _CLU + "SELECT graph, node, degree, triangles, round(CAST(clustering AS DOUBLE), 6) AS clustering FROM clu",
    "graph_common_neighbours": _LOCAL + "SELECT graph, u, v, common FROM com",
    "graph_local_bridges": _over(_TRADE, _USERS, _SUPPLY) + "SELECT graph, node, count(*) AS bridges FROM (SELECT graph, u AS node FROM com WHERE common = 0 UNION ALL SELECT graph, v FROM com WHERE common = 0) GROUP BY ALL",
    "graph_sphere": _over(_TRADE, _SUPPLY) + "SELECT graph, node, count(*) AS at_two FROM two GROUP BY ALL",
    "graph_stats": _LOCAL + _CLU + "SELECT graph, nodes, edges, round(2.0 * edges / nodes, 6) AS mean_degree, round(mean_clustering, 6) AS mean_clustering FROM (SELECT graph, count(*) AS nodes, avg(CAST(clustering AS DOUBLE)) AS mean_clustering FROM clu GROUP BY graph) JOIN (SELECT graph, count(*) AS edges FROM edges GROUP BY graph) USING (graph)",
    "graph_components": _over(_SUPPLY) + ", lab AS (SELECT node, node AS label FROM deg UNION SELECT a.dst, l.label FROM lab l JOIN adj a ON a.src = l.node WHERE l.label < a.dst) SELECT node, min(label) AS component FROM lab GROUP BY node",
    "graph_largest_component": _over(_SUPPLY) + ", lab AS (SELECT node, node AS label FROM deg UNION SELECT a.dst, l.label FROM lab l JOIN adj a ON a.src = l.node WHERE l.label < a.dst), c AS (SELECT node, min(label) AS label FROM lab GROUP BY node), b AS (SELECT arg_max(label, (size, label)) AS label FROM (SELECT label, count(*) AS size FROM c GROUP BY label)), n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM c WHERE label = (SELECT label FROM b)) SELECT e.graph, least(x.i, y.i) AS u, greatest(x.i, y.i) AS v FROM edges e JOIN n x ON x.node = e.u JOIN n y ON y.node = e.v",
    "graph_chain": _over(_SUPPLY) + _LEFT.format(rate=0.07) + ", both_ways AS (SELECT u AS src, v AS dst FROM rest UNION ALL SELECT v, u FROM rest), lab AS (SELECT src AS node, src AS label FROM both_ways UNION SELECT a.dst, l.label FROM lab l JOIN both_ways a ON a.src = l.node WHERE l.label < a.dst), c AS (SELECT DISTINCT label FROM (SELECT node, min(label) AS label FROM lab GROUP BY node)) SELECT * FROM (SELECT 'supply' AS graph, label AS u, lead(label) OVER (ORDER BY label) AS v FROM c) WHERE v IS NOT NULL",
    "graph_edge_sample": _ALL + "SELECT graph, least(1600, count(*)) AS edges FROM edges GROUP BY graph",
    "graph_residual": _ALL + _LEFT.format(rate=0.05) + "SELECT * FROM rest",
    "graph_user_successors": "SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id), -1) AS next_event_id FROM events",
    "order_degree": _ALL + _DEGREE_ORDER,
    "order_collective_influence": _LOCAL + _CI + _order("ci", "SELECT * FROM ci"),
    "order_cluster_rank": _LOCAL + _CLU + _order("cluster_rank", "SELECT c.graph, c.node, pow(10.0, -CAST(c.clustering AS DOUBLE)) * sum(d.degree + 1) AS score FROM clu c JOIN adj a ON a.graph = c.graph AND a.src = c.node JOIN deg d ON d.graph = a.graph AND d.node = a.dst GROUP BY c.graph, c.node, c.clustering"),
    "order_neighbour_distance": _LOCAL + _order("ndc", "SELECT d.graph, d.node, CAST(sum(d.degree - common) AS DOUBLE) / count(*) AS score FROM deg d JOIN (SELECT graph, u AS node, common FROM com UNION ALL SELECT graph, v, common FROM com) USING (graph, node) GROUP BY d.graph, d.node"),
    "order_highest_degree": _highest_degree(),
    "order_core_first": _core_first(),
    "order_timed": _over(_TRADE) + "SELECT 'trade' AS graph, 'hda_fast' AS method, CAST(count(*) AS INTEGER) AS steps, NULL AS error FROM deg UNION ALL SELECT 'trade', 'broken', 0, 'ZeroDivisionError: integer division or modulo by zero'",
    "graph_core_numbers": _over(_TRADE, _SUPPLY) + _CORES + "SELECT * FROM core",
    "graph_communities": _LOCAL + _LABELS + "SELECT graph, node, label AS community FROM com_of",
    "order_ncdc": _LOCAL + _LABELS + _order("ncdc", _DISTANCES + "SELECT graph, node, avg(lack * CASE WHEN same THEN 0.5 ELSE 1.0 END) AS score FROM near GROUP BY ALL"),
    "order_ndjc": _LOCAL + _LABELS + _order("ndjc", _DISTANCES + "SELECT graph, node, avg(lack * CASE WHEN same THEN 0.5 ELSE 1.0 END / both_size) AS score FROM near GROUP BY ALL"),
    "order_core": _over(_TRADE, _SUPPLY) + _CORES + "SELECT graph, 'core' AS method, CAST(row_number() OVER (PARTITION BY graph ORDER BY core DESC, degree DESC, node DESC) AS INTEGER) AS step, node FROM core JOIN deg USING (graph, node)",
    "order_betweenness": _over(_TRADE, _SUPPLY) + _BETWEEN + _order("betweenness", "SELECT * FROM between"),
    "order_completed": _ON_SUPPLY + ", listed AS (SELECT node, min(node % 97) AS at FROM deg WHERE degree >= 3 GROUP BY node) SELECT 'supply' AS graph, 'listed' AS method, CAST(row_number() OVER (ORDER BY l.node IS NULL, l.at, d.node) AS INTEGER) AS step, d.node FROM deg d LEFT JOIN listed l ON l.node = d.node",
    "curve_states": _STATES,
    "curve_forest": _STATES,
    "curve_metrics": _ONE + "SELECT graph, step, round(gcc, 6) AS gcc, ncc, round(top5_mass, 6) AS top5_mass, round(hhi, 6) AS hhi, round(ec, 6) AS ec, round(pd, 6) AS pd, round(cnbi, 6) AS cnbi FROM met",
    "curve_running": _ONE + "SELECT graph, step, round(avg(gcc) OVER w, 6) AS running_r, round(avg(cnbi) OVER w, 6) AS running_cnbi FROM met WINDOW w AS (ORDER BY step ROWS UNBOUNDED PRECEDING)",
    "curve_summary": _BOTH + "SELECT graph, method, steps, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUMMARY) + " FROM summ",
    "curve_advantage": _BOTH + "SELECT a.method, round(avg(a.auc_cnbi - b.auc_cnbi), 6) AS auc_adv, round(avg(b.r - a.r), 6) AS r_adv, round(avg(0.45 * (a.early_cnbi - b.early_cnbi) + 0.35 * (a.early_ncc - b.early_ncc) + 20 * (b.early_gcc - a.early_gcc)), 6) AS early, round(min(a.auc_cnbi - b.auc_cnbi), 6) AS worst FROM summ a JOIN summ b ON b.method = 'degree' AND a.method = 'ci' GROUP BY a.method",
    "curve_residual_means": _BOTH + "SELECT graph, method, round(avg(gcc), 6) AS r, round(avg(cnbi_left), 6) AS cnbi, round(avg(top5 / CAST(greatest(1, rest) AS DOUBLE)), 6) AS top5_mass, round(avg(hhi), 6) AS hhi, round(avg(pd_left), 6) AS pd FROM met GROUP BY ALL",
    "curve_paper_variant": _BOTH + "SELECT graph, method, step, round(pd_left, 6) AS pd, round(cnbi_paper, 6) AS cnbi FROM met",
    "curve_area_floor": _BOTH + "SELECT graph, method, round(sum(dx * yg) / greatest(max(ratio) - min(ratio), 0.5), 6) AS auc_gcc, round(sum(dx * yc) / greatest(max(ratio) - min(ratio), 0.5), 6) AS auc_cnbi FROM seg GROUP BY graph, method",
    "graph_largest_pieces": _over(_TRADE, _USERS, _SUPPLY) + _LEFT.format(rate=0.05) + ", few AS (SELECT * FROM edges WHERE graph <> 'supply' UNION ALL SELECT * FROM rest WHERE graph = 'supply'), two_ways AS (SELECT graph, u AS src, v AS dst FROM few UNION ALL SELECT graph, v, u FROM few), ends AS (SELECT DISTINCT graph, src AS node FROM two_ways), "
        "home AS (SELECT graph, node, node AS label FROM ends UNION SELECT h.graph, a.dst, h.label FROM home h JOIN two_ways a ON a.graph = h.graph AND a.src = h.node WHERE h.label < a.dst), part AS (SELECT graph, node, min(label) AS part FROM home GROUP BY ALL), "
        "lab AS (SELECT p.graph, p.node AS gone, q.node, q.node AS label FROM part p JOIN part q ON q.graph = p.graph AND q.part = p.part AND q.node <> p.node UNION SELECT l.graph, l.gone, a.dst, l.label FROM lab l JOIN two_ways a ON a.graph = l.graph AND a.src = l.node WHERE a.dst <> l.gone AND l.label < a.dst), "
        "least AS (SELECT graph, gone, node, min(label) AS label FROM lab GROUP BY ALL), chunk AS (SELECT graph, gone, label, count(*) AS size FROM least GROUP BY ALL) SELECT graph, gone AS node, max(size) AS piece FROM chunk GROUP BY graph, gone HAVING count(*) > 1",
    "curve_value_at": _BOTH + "SELECT graph, method, round(arg_min(cnbi, (abs(ratio - 0.2), step)), 6) AS value FROM met GROUP BY ALL",
    "curve_component_states": _over(_SUPPLY) + ", lab AS (SELECT node, node AS label FROM deg UNION SELECT a.dst, l.label FROM lab l JOIN adj a ON a.src = l.node WHERE l.label < a.dst), part AS (SELECT label, count(*) AS size FROM (SELECT node, min(label) AS label FROM lab GROUP BY node) GROUP BY label) SELECT 'supply' AS graph, 'none' AS method, CAST(0 AS INTEGER) AS step, CAST(sum(size) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS \"left\", max(size) AS largest, count(*) AS ncc, CAST(list_sum(list_slice(list_reverse_sort(list(size)), 1, 5)) AS BIGINT) AS top5, CAST(sum(size * size) AS BIGINT) AS squares FROM part",
}
