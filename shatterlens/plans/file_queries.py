"""Queries that write tables in each of the formats of a study, read them back and give what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shatterlens.functions import programs as pg
from shatterlens.operators import publishing as pb
from shatterlens.plans import graph_queries as gq
from shatterlens.plans.record_queries import _M, _R, metrics, records, rounded
from shatterlens.scratch import Scratch
from shatterlens.sources import files, graphs, sinks
from shatterlens.sources.tables import table

_NUMBERS = "r double, auc_cnbi double, time_s double"


def _place(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark).root}/{name}"


def _listed(spark: SparkSession, d: str) -> str:
    """Trading nations as an edge list, one file in ascending order, with lines that are none."""
    path = _place(spark, "edges")
    edges = graphs.nation_trade(spark, d)
    lines = edges.select("u", "v", F.concat_ws(" ", F.col("v").cast("string"), F.col("u").cast("string")).alias("value"))
    odd = spark.createDataFrame([(-1, 0, "# from to"), (-1, 1, "7 7"), (-1, 2, "x 3")], "u bigint, v bigint, value string")
    odd.unionByName(lines).coalesce(1).sortWithinPartitions("u", "v").select("value").write.text(path)
    return path


def files_edge_list(spark, d):
    return graphs.read_edge_list(spark, _listed(spark, d), "trade")[0]


def files_edge_list_nodes(spark, d):
    """Nodes by their first appearance in the list."""
    return graphs.read_edge_list(spark, _listed(spark, d), "trade")[1]


def files_node_link(spark, d):
    """Trading nations as one node-link object; a graph of at most 25 nodes is one row."""
    path = _place(spark, "suite")
    links = graphs.nation_trade(spark, d).agg(F.collect_list(F.struct(F.col("u").alias("source"), F.col("v").alias("target"))).alias("links"))
    links.select(F.concat(F.lit("["), F.to_json(F.struct("links")), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return graphs.read_node_link(spark, path)


def files_csv(spark, d):
    """Metrics through a CSV with a byte order mark."""
    path = _place(spark, "csv")
    sinks.write_csv(metrics(spark, d).select("dataset", "method", "r", "auc_cnbi", "time_s"), path)
    return rounded(files.read_csv(spark, path, f"dataset string, method string, {_NUMBERS}"))


def files_columns(spark, d):
    """Two of the columns of a CSV, and one that it lacks."""
    path = _place(spark, "columns")
    sinks.write_csv(metrics(spark, d).select("dataset", "method", "source", "r"), path, mark=False)
    return files.read_columns(spark, path, ["method", "source", "nothing"])


def files_points(spark, d):
    """Points in folders by dataset and method; one method is read."""
    path = _place(spark, "points")
    points = metrics(spark, d).where("r is not null").select("dataset", "method", F.col("source").alias("step"), "r")
    sinks.write_points(points, path)
    return rounded(files.read_points(spark, path).where("method = 'core-peel'").select("dataset", "method", "step", "r"))


def files_log(spark, d):
    """Records appended to a log of JSON lines in two turns."""
    path = _place(spark, "log")
    rows = records(spark, d).select("run_id", "node_id", "idx", "valid")
    sinks.append_log(rows.where("valid"), path)
    sinks.append_log(rows.where("not valid"), path)
    return files.read_log(spark, path, "run_id string, node_id string, idx int, valid boolean")


def files_recorded_order(spark, d):
    """An order as a table of text, with rows that are no removals, read as an order."""
    edges = gq.stored(graphs.nation_trade(spark, d))
    order = gq.so.degree_order(edges, graphs.nodes_of(edges))
    text = order.select("step", F.concat(F.col("node").cast("string"), F.when(F.col("step") % 2 == 0, ".0").otherwise("")).alias("removed_node"))
    odd = spark.createDataFrame([(0, "5"), (99, "none"), (98, None)], "step int, removed_node string")
    return files.recorded_order(text.unionByName(odd), "trade", "recorded")


def files_markdown(spark, d):
    """A table of means as Markdown in a document, read from it."""
    path = _place(spark, "markdown")
    rows = pb.means_by_size(metrics(spark, d), F.col("valid"), ["r"], ["method"]).select("method", "runs")
    head = spark.createDataFrame([("# Means",), ("| method | runs |",), ("|---|---|",)], "line string").withColumn("at", F.lit(0))
    body = pb.markdown_rows(rows, ["method", "runs"]).withColumn("at", F.lit(1))
    head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    cells = files.read_markdown_tables(spark, path)
    return cells.where("row > 0").select(F.col("cells")[0].alias("method"), F.col("cells")[1].alias("runs"))


def files_programs(spark, d):
    """Programs as one file each, named by what they hold."""
    path = _place(spark, "programs")
    table(spark, d, "candidate_programs").where("code <> ''").select("code").distinct().write.option("maxRecordsPerFile", 1).text(path)
    return files.read_programs(spark, path, stage="stored").drop("path")


def files_version(spark, d):
    """A table's second version beside the first."""
    path = _place(spark, "versions")
    rows = metrics(spark, d).select("dataset", "method", "source")
    sinks.write_version(rows.where("source = 'recorded'"), path, "1")
    second = sinks.write_version(rows.where("source <> 'recorded'"), path, "2")
    return spark.read.parquet(second)


def files_beside(spark, d):
    """A table that goes to its place, as nothing forbids that."""
    path = _place(spark, "place")
    return spark.read.parquet(sinks.write_or_beside(table(spark, d, "nation"), path, f"{path}-2"))


def text_forbidden_parts(spark, d):
    """What programs must not contain and do."""
    rows = table(spark, d, "candidate_programs").where("code is not null").select("candidate_id", "code").distinct()
    return rows.select("candidate_id", F.explode(pg.forbidden_parts(F.col("code"))).alias("part"))


def text_program_faults(spark, d):
    """Faults of every program by their kinds, from its syntax tree."""
    found = pg.checked(table(spark, d, "candidate_programs"), "candidate_id", "code", strict=True)
    return found.groupBy("candidate_id", "kind").agg(F.count(F.lit(1)).alias("faults"))


def table_fixed_cases(spark, d):
    """Fixed cases looked up in the pool of steps with exactly the same largest part."""
    met = gq.fr.with_metrics(gq._two_orders(spark, d))
    pool = Scratch(spark).save(pb.hidden_cases(met, 1e-9, 0.0, None), "pool")
    keys = ["graph", "method_a", "method_b", "step_a", "step_b"]
    wanted = pool.where("gcc_abs_diff = 0").orderBy(F.desc("step_a")).limit(3).select(*keys)
    return rounded(pb.fixed_cases(pool, wanted, keys).select(*keys, "hidden_gap"), 6)


def table_mapped(spark, d):
    """Names of sources exchanged, others as they are."""
    return pb.mapped(metrics(spark, d).select("dataset", "method", "source"), "source", {"recorded": "paper", "rerun": "again"})


def table_means_by_size(spark, d):
    """Means by method and number of nodes of the rows that are fine."""
    rows = table(spark, d, "per_graph_metrics").select("dataset", "method", "source", "nodes", "valid", "r", "time_s").distinct()
    rows = rows.withColumns({c: F.nullif(c, F.lit(float("nan"))) for c in ("r", "time_s")})
    return rounded(pb.means_by_size(rows, F.col("valid"), ["r", "time_s"], ["method", "nodes"]))


QUERIES = {f.__name__: f for f in (
    files_edge_list, files_edge_list_nodes, files_node_link, files_csv, files_columns, files_points, files_log, files_recorded_order, files_markdown, files_programs, files_version, files_beside,
    text_forbidden_parts, text_program_faults, table_fixed_cases, table_mapped, table_means_by_size,
)}

_PARTS = ", ".join(f"'{p}'" for p in pg.FORBIDDEN)
ORACLES = {
    "files_edge_list": gq._TRADE,
    "files_edge_list_nodes": f"WITH e AS ({gq._TRADE}), f AS (SELECT row_number() OVER (ORDER BY u, v) * 2 AS spot, u, v FROM e), a AS (SELECT v AS node, spot FROM f UNION ALL SELECT u, spot + 1 FROM f) SELECT 'trade' AS graph, node, CAST(row_number() OVER (ORDER BY min(spot)) AS INTEGER) AS ord FROM a GROUP BY node",
    "files_node_link": f"SELECT '0' AS graph, u, v FROM ({gq._TRADE})",
    "files_csv": _M + "SELECT dataset, method, round(r, 9) AS r, round(auc_cnbi, 9) AS auc_cnbi, round(time_s, 9) AS time_s FROM m",
    "files_columns": _M + "SELECT method, source FROM m",
    "files_points": _M + "SELECT dataset, method, source AS step, round(r, 9) AS r FROM m WHERE r IS NOT NULL AND method = 'core-peel'",
    "files_log": _R + "SELECT run_id, node_id, idx, valid FROM rec",
    "files_recorded_order": gq._over(gq._TRADE) + "SELECT graph, 'recorded' AS method, CAST(row_number() OVER (ORDER BY degree DESC, CAST(node AS VARCHAR) DESC) AS INTEGER) AS step, node FROM deg",
    "files_markdown": _M + "SELECT method, CAST(count(*) AS VARCHAR) AS runs FROM m WHERE valid GROUP BY method",
    "files_programs": "SELECT left(sha1(code || chr(10)), 12) AS candidate_id, code || chr(10) AS code, 'unknown' AS family, 'stored' AS source_stage FROM (SELECT DISTINCT code FROM candidate_programs WHERE code <> '')",
    "files_version": _M + "SELECT dataset, method, source FROM m WHERE source <> 'recorded'",
    "files_beside": "SELECT * FROM nation",
    "text_forbidden_parts": f"SELECT candidate_id, part FROM (SELECT DISTINCT candidate_id, code FROM candidate_programs WHERE code IS NOT NULL), (SELECT unnest([{_PARTS}]) AS part) WHERE contains(lower(code), part)",
    "table_fixed_cases": gq._BOTH + ", pool AS (SELECT a.graph, a.method AS method_a, b.method AS method_b, a.step AS step_a, b.step AS step_b, abs(a.gcc - b.gcc) AS diff, abs(a.cnbi - b.cnbi) AS gap, row_number() OVER (PARTITION BY a.step ORDER BY abs(a.gcc - b.gcc), b.step) AS n FROM met a JOIN met b ON a.method = 'ci' AND b.method = 'degree' AND abs(a.gcc - b.gcc) <= 1e-9) "
        "SELECT graph, method_a, method_b, step_a, step_b, round(gap, 6) AS hidden_gap FROM pool WHERE n = 1 AND diff = 0 ORDER BY step_a DESC LIMIT 3",
    "table_mapped": _M + "SELECT dataset, method, CASE source WHEN 'recorded' THEN 'paper' WHEN 'rerun' THEN 'again' ELSE source END AS source FROM m",
    "table_means_by_size": "SELECT method, nodes, count(*) AS runs, round(avg(r), 9) AS mean_r, round(avg(time_s), 9) AS mean_time_s FROM (SELECT DISTINCT dataset, method, source, nodes, valid, CASE WHEN NOT isnan(r) THEN r END AS r, CASE WHEN NOT isnan(time_s) THEN time_s END AS time_s FROM per_graph_metrics) WHERE valid GROUP BY ALL",
}
