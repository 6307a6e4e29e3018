"""Queries over result tables, program text, and logs as they grow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from shatterlens.functions import features as fe, scalars as sc
from shatterlens.operators import policies as po, publishing as pb
from shatterlens.plans.graph_queries import _BOTH, rounded
from shatterlens.plans.record_queries import _M, _R, metrics, records
from shatterlens.scratch import shared_root
from shatterlens.sources import sinks
from shatterlens.sources.tables import table
from shatterlens.streaming import progress as sp

METHODS = ("core-peel", "degree-plain", "rim-cut", "tie-walker")


def table_pivot(spark, d):
    """Mean area per dataset and chosen method."""
    out = metrics(spark, d).groupBy("dataset").pivot("method", list(METHODS)).agg(F.avg("auc_cnbi"))
    return rounded(out.select("dataset", *[F.col(f"`{m}`").alias(m.replace("-", "_")) for m in METHODS]))


def table_percentiles(spark, d):
    """Interpolated quantiles of the area."""
    out = metrics(spark, d).groupBy("method_group").agg(*[F.percentile("auc_cnbi", p / 100).alias(f"p{p}") for p in (25, 50, 55, 80)])
    return rounded(out)


def table_most_common(spark, d):
    """Five most common families of each run; ties by first appearance."""
    counts = records(spark, d).groupBy("run_id", "family").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "first_idx", "family"))
    return counts.withColumn("place", place).where("place <= 5")


def table_times(spark, d):
    """Median, sum and mean of times; unknown ones count as 0 in the mean of sums."""
    both = F.coalesce("time_s", F.lit(0.0)) + F.coalesce("proxy_time_s", F.lit(0.0))
    out = records(spark, d).groupBy("run_id").agg(F.median("time_s").alias("median_s"), F.sum("time_s").alias("total_s"), F.avg(both).alias("mean_logged_s"), (F.sum(both) / 3600).alias("total_h"))
    return rounded(out, 10)


def table_gap(spark, d):
    out = metrics(spark, d).where("valid").groupBy("dataset").agg(F.min("r").alias("least"), F.max("r").alias("most"), (F.max("r") - F.min("r")).alias("gap"), F.countDistinct("method").alias("methods"))
    return rounded(out, 9)


def table_completeness(spark, d):
    return pb.completeness(metrics(spark, d), ["method"], F.col("valid") & F.col("auc_cnbi").isNotNull())


def table_nearest(spark, d):
    """Each customer with the supplier of its nation nearest in balance, within 30."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("suppkey"), F.col("s_acctbal").alias("bal"))
    return pb.nearest_within(c, s, ["nation"], "bal", "suppkey", 30.0).select("nation", "custkey", "suppkey_b", F.round("gap", 6).alias("gap"))


def _published(spark, d):
    return metrics(spark, d).where("source = 'recorded'").select("dataset", "method", "r", "auc_cnbi", "time_s")


def table_refresh(spark, d):
    """Recorded rows with those of two methods replaced by scaled ones."""
    new = metrics(spark, d).where(F.col("method").isin("rim-cut", "core-peel")).select("dataset", "method", (F.col("auc_cnbi") * 2).alias("auc_cnbi"), F.lit("new").alias("origin"))
    return pb.refreshed(_published(spark, d).withColumn("origin", F.lit("old")), new, ["method"])


def table_audit(spark, d):
    """Recorded values against shifted ones, some of which are not there."""
    actual = _published(spark, d).where("method <> 'rim-cut'").withColumn("auc_cnbi", F.col("auc_cnbi") + F.when(F.col("method") == "core-peel", 0.5).otherwise(0.0001))
    return pb.audited(_published(spark, d), actual, ["dataset", "method"], {"r": 0.001, "auc_cnbi": 0.01}).select("dataset", "method", "column", "status")


def table_union_by_name(spark, d):
    """Tables of different columns, stacked."""
    a = metrics(spark, d).select("dataset", "method", "r")
    b = metrics(spark, d).where("valid").select("method", "dataset", F.col("time_s").alias("seconds"))
    return a.unionByName(b, allowMissingColumns=True)


def table_ratio(spark, d):
    """Means relative to those of one method."""
    means = po.rank_then_count(metrics(spark, d), "dataset", "method").select("method", "mean_auc_cnbi", "mean_time_s")
    out = pb.ratio_to(means, "method", "core-peel", {"mean_auc_cnbi": "retention", "mean_time_s": "speedup"}, ["mean_time_s"])
    return out.select("method", sc.percent_label(F.col("retention")).alias("retention"), sc.factor_label(F.col("speedup")).alias("speedup"))


def table_hidden_cases(spark, d):
    """Steps of two removal orders with the same largest part but different spread, of all steps."""
    from shatterlens.operators import fragmentation as fr
    from shatterlens.plans.graph_queries import _two_orders

    return rounded(pb.hidden_cases(fr.with_metrics(_two_orders(spark, d)), 0.003, 0.05, None).select("method_a", "method_b", "step_a", "step_b", "hidden_gap"))


def table_strided(spark, d):
    """About ten records of each run, evenly spaced: a sampling operator."""
    return pb.strided(records(spark, d), ["run_id"], "idx", 10).select("run_id", "node_id", "idx")


def table_manifest(spark, d):
    return sinks.manifest(metrics(spark, d), "points")


def table_markdown(spark, d):
    rows = po.rank_then_count(metrics(spark, d), "dataset", "method").select("method", "datasets", "top1_auc")
    return pb.markdown_rows(rows, ["method", "datasets", "top1_auc"])


def table_tree_edges(spark, d):
    return sinks.tree_edges(records(spark, d)).groupBy("source").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("valid").cast("bigint")).alias("valid_edges"))


def table_filters(spark, d):
    """Membership, substring, band and null predicates together."""
    m = metrics(spark, d)
    good = m.where(F.col("method_group").isin("final", "baseline") & ~F.col("dataset").isin("quarry") & F.lower("method").contains("e") & (F.abs(F.col("r") - 0.25) <= 0.1)).na.drop(subset=["auc_cnbi", "time_s"])
    return good.select("dataset", "method", F.col("method_group").alias("kind"), F.lit(1).alias("weight"), sc.compressed_log(F.col("time_s")).alias("log_time")).withColumn("log_time", F.round("log_time", 6))


def table_semi_anti(spark, d):
    """Runs with a record of the seldom families, less those that have timeouts."""
    r = records(spark, d)
    some = r.where("family like 'core_frontier/%'").select("run_id").distinct()
    late = r.where(F.contains("error", F.lit("timeout"))).select("run_id").distinct()
    return r.select("run_id").distinct().join(some, "run_id", "left_semi").join(late, "run_id", "left_anti").unionByName(late.exceptAll(some))


def table_lookup(spark, d):
    """Nation of each customer by key, else by balance class; unmatched ones are marked."""
    nation = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    other = table(spark, d, "region").select(F.col("r_regionkey").alias("k2"), F.col("r_name").alias("b"))
    c = table(spark, d, "customer")
    joined = c.join(nation, F.col("c_nationkey") == F.col("k"), "left").join(other, F.col("c_nationkey") == F.col("k2"), "left")
    label = F.coalesce("a", "b")
    return joined.groupBy(F.coalesce(label, F.lit("missing")).alias("label")).agg(F.count(F.lit(1)).alias("customers"), F.avg(label.isNull().cast("double")).alias("missing_rate"))


def programs(spark, d):
    return table(spark, d, "candidate_programs").where("candidate_id is not null").select("candidate_id", F.coalesce("code", F.lit("")).alias("code"), "family").distinct()


def text_main_flags(spark, d):
    flags = fe.main_flags(F.col("code"))
    return programs(spark, d).select("candidate_id", *[c.alias(k) for k, c in flags.items()], fe.main_family(F.col("code")).alias("main_family"), fe.signature(flags).alias("signature"))


def text_learned(spark, d):
    flags = fe.learned_flags(F.col("code"))
    return programs(spark, d).select("candidate_id", *[c.alias(k) for k, c in flags.items()], fe.learned_family(flags).alias("learned_family"))


def text_generic(spark, d):
    code = F.col("code")
    return programs(spark, d).select("candidate_id", fe.generic_signature(code).alias("generic"), fe.map_bin(code).alias("map_bin"), fe.contract_violation(code).alias("violation"), sc.hash_prefix(code, 16).alias("code_hash"))


def text_experiment_flags(spark, d):
    flags = fe.experiment_flags(F.col("code"))
    return programs(spark, d).select("candidate_id", *[c.alias(k) for k, c in flags.items()])


def text_failure_patterns(spark, d):
    """Counts and rates of the slow patterns."""
    flags = fe.main_flags(F.col("code"))
    names = ["component_refresh", "global_rescan", "unbounded_two_hop", "heap_update"]
    return rounded(po.flag_counts(programs(spark, d).select(*[flags[n].alias(n) for n in names]), names))


def text_replies(spark, d):
    """Code within replies: its length, head and tail, and whether it was fenced."""
    calls = table(spark, d, "llm_calls").select("prompt_id", "raw_response").distinct().where("raw_response is not null")
    code = sc.fenced_code(F.col("raw_response"))
    return calls.select("prompt_id", F.length(code).alias("n"), F.md5(sc.head_and_tail(code, 200).cast("binary")).alias("ends"))


def text_json(spark, d):
    """A field of the outermost JSON object within free text."""
    e = table(spark, d, "events").withColumn("note", F.concat(F.lit("props: "), "props", F.lit(" end")))
    return e.select("event_id", F.get_json_object(sc.json_object(F.col("note")), "$.k").cast("int").alias("k"))


def text_finite(spark, d):
    """Scores as finite numbers, others and none as -1."""
    rows = table(spark, d, "search_records").select("run_id", "node_id", "rank_score", "ingested_at").distinct()
    return rounded(rows.select("run_id", "node_id", sc.finite_or(F.col("rank_score"), -1.0).alias("score")), 9)


def text_shortened(spark, d):
    """Long programs with their middle left out."""
    rows = table(spark, d, "candidate_programs").where("code is not null").select("candidate_id", "code").distinct()
    return rows.select("candidate_id", sc.head_and_tail(F.col("code"), 600).alias("code"))


def text_scalars(spark, d):
    """Scalar rules over names and numbers of the parts."""
    p = table(spark, d, "part")
    size = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("%", " s", "h", "x"))), F.col("p_size") % 4 + 1))
    return p.select(
        "p_partkey", sc.slug(F.col("p_name")).alias("slug"), sc.measure(F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(size)).alias("measure"), sc.snap(F.col("p_retailprice"), [900.0, 1000.0, 1500.0]).alias("snapped"),
        sc.truthy(F.element_at(F.array(*map(F.lit, ("Yes", " ok", "0", "TRUE ", "y"))), (F.col("p_size") % 5 + 1).cast("int")), "wide").alias("truth"), F.size(sc.list_items(F.concat_ws(",", "p_type", F.lit(" "), "p_brand"))).alias("items"),
        sc.clamp(F.col("p_retailprice"), 950.0, 1200.0).alias("clamped"), F.rint(F.col("p_size") * 0.5).alias("half_even"),
    )


def text_mixed_keys(spark, d):
    """Labels that are integers sort by value and before words."""
    from pyspark.sql import Window

    label = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_partkey").cast("string"))
    keyed = table(spark, d, "part").select("p_partkey", "p_size", label.alias("label"))
    return keyed.select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy(sc.mixed_key(F.col("label")), "p_partkey")).alias("place"))


def text_dates(spark, d):
    return table(spark, d, "events").groupBy(sc.date_label(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("events"))


def _run_stream(spark: SparkSession, sf_dir: str, name: str, transform, mode: str) -> DataFrame:
    """Run a stream over the stored events to its end; the result is a written table."""
    schema = table(spark, sf_dir, "events").schema
    root = f"{shared_root(spark)}/shatterlens-stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parquet*"  # a stream reads a pattern, so that one file will do
    out = f"{root}/out"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = transform(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(put).queryName(f"{name}-{root[-8:]}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def stream_progress(spark, d):
    """Progress of a log read as a stream: the last state of each key."""
    seen = _run_stream(spark, d, "progress", lambda s: sp.progress(s.withColumn("value", F.round("value", 2).cast("decimal(18,2)")), "event_type"), "complete")
    last = seen.agg(F.max("epoch").alias("epoch"))
    return seen.join(F.broadcast(last), "epoch").select("event_type", "rows", F.col("total").cast("double").alias("total"))


def stream_windows(spark, d):
    """Rows per day and type of a stream; windows come out once they are past."""
    seen = _run_stream(spark, d, "windows", lambda s: sp.windowed(s, "ts", "event_type"), "append")
    return seen.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type").agg(F.sum("rows").alias("rows"))


def stream_credit(spark, d):
    """Exponential credit of each type, held as state over a stream."""
    prepare = lambda s: sp.credit_stream(s.select("event_type", F.col("event_id").alias("idx"), (F.col("value") / 100).alias("reward")), "event_type")
    seen = _run_stream(spark, d, "credit", prepare, "update")
    return rounded(seen.groupBy("event_type").agg(F.max_by("credit", "n").alias("credit"), F.max("n").alias("n")))


_plain = [v for k, v in list(globals().items()) if k.startswith(("table_", "text_", "stream_"))]
QUERIES = {f.__name__: f for f in _plain}

_P = "WITH p AS (SELECT DISTINCT candidate_id, coalesce(code, '') AS code, family FROM candidate_programs WHERE candidate_id IS NOT NULL), t AS (SELECT *, lower(code) AS x, CAST((length(lower(code)) - length(replace(lower(code), 'neighbors(', ''))) / 10 AS INTEGER) AS c FROM p) "


def _has(*parts: str, column: str = "x") -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


_MAIN = {k: _has(*v) + (f" OR c >= {fe.MAIN_CALLS[k]}" if k in fe.MAIN_CALLS else "") for k, v in fe.MAIN_PARTS.items()} | {"unbounded_two_hop": "c >= 2 AND NOT " + _has("cap", "limit", "break")}
_FLAGGED = _P + ", f AS (SELECT *, " + ", ".join(f"({e}) AS {k}" for k, e in _MAIN.items()) + " FROM t) "
_SIG = "coalesce(nullif(concat_ws('|', " + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in fe.SIGNATURE) + "), ''), 'plain')"
_FAMILY = f"CASE WHEN {_has('connected_components')} THEN 'component-refresh' WHEN contains(x, 'two') OR c >= 2 THEN 'two-hop-boundary' WHEN {_has('clustering', 'redund')} THEN 'redundancy-aware' WHEN contains(x, 'heapq') THEN 'heap-local-update' WHEN contains(x, 'degree') THEN 'degree-local' ELSE 'other' END"
_LEARNED = ", l AS (SELECT candidate_id, " + ", ".join("regexp_matches(x, '" + "|".join(v) + f"') AS {k}" for k, v in fe.LEARNED_PATTERNS.items()) + " FROM t) "
_IDEAS = {"heap": "contains(code, 'heap')", "core": _has("core"), "tri": _has("tri", "cluster"), "component": _has("component", "connected"), "neighbor": _has("neighbor", "nbr"), "twohop": f"contains(x, '2') AND {_has('hop', 'two')}"}
_GENERIC = "coalesce(nullif(array_to_string(list_slice(list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{k}' END" for k, e in _IDEAS.items()) + "], lambda z: z IS NOT NULL), 1, 3), '+'), ''), 'simple')"
_LOOPS = "(length(code) - length(replace(code, 'for ', ''))) / 4 + (length(code) - length(replace(code, 'while ', ''))) / 6"
_TWO, _CAP = _has("two", "2-hop", "single_source_shortest_path"), _has("cap", "limit", "[:", "break")
_EXP = {
    "degree_backbone": _has("degree"), "frontier": _has("frontier", "neighbor", "boundary"), "weak_tie": _has("weak", "<= 2", "<=2", "low"), "boundary": f"{_has('boundary')} OR {_TWO}",
    "redundancy": _has("redundan", "cluster", "triangle", "overlap"), "phase": _has("phase", "progress", "len(order)"), "heap_update": _has("heap", "bucket"),
    "global_rescan": _has("connected_components", "core_number", "k_core"), "unbounded_two_hop": f"{_TWO} AND NOT {_CAP}", "connected_components": _has("connected_components"),
}
_OLD = _M + ", o AS (SELECT dataset, method, r, auc_cnbi, time_s FROM m WHERE source = 'recorded') "
_COUNTED = ", mm AS (SELECT method, count(DISTINCT dataset) AS datasets, avg(auc_cnbi) AS a, avg(time_s) AS t, count(*) FILTER (WHERE rk <= 1) AS top1 FROM (SELECT *, CASE WHEN auc_cnbi IS NOT NULL THEN rank() OVER (PARTITION BY dataset ORDER BY auc_cnbi DESC NULLS LAST) + (count(*) OVER (PARTITION BY dataset, auc_cnbi) - 1) / 2.0 END AS rk FROM m WHERE valid) GROUP BY method) "

ORACLES = {
    "table_pivot": _M + "SELECT dataset, " + ", ".join(f"round(avg(auc_cnbi) FILTER (WHERE method = '{m}'), 6) AS {m.replace('-', '_')}" for m in METHODS) + " FROM m GROUP BY dataset",
    "table_percentiles": _M + "SELECT method_group, " + ", ".join(f"round(quantile_cont(auc_cnbi, {p / 100}), 6) AS p{p}" for p in (25, 50, 55, 80)) + " FROM m GROUP BY method_group",
    "table_most_common": _R + "SELECT * FROM (SELECT run_id, family, count(*) AS n, min(idx) AS first_idx, CAST(row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, min(idx), family) AS INTEGER) AS place FROM rec GROUP BY run_id, family) WHERE place <= 5",
    "table_times": _R + "SELECT run_id, round(quantile_cont(time_s, 0.5), 10) AS median_s, round(sum(time_s), 10) AS total_s, round(avg(coalesce(time_s, 0) + coalesce(proxy_time_s, 0)), 10) AS mean_logged_s, round(sum(coalesce(time_s, 0) + coalesce(proxy_time_s, 0)) / 3600, 10) AS total_h FROM rec GROUP BY run_id",
    "table_gap": _M + "SELECT dataset, min(r) AS least, max(r) AS most, round(max(r) - min(r), 9) AS gap, count(DISTINCT method) AS methods FROM m WHERE valid GROUP BY dataset",
    "table_completeness": _M + "SELECT method, count(*) AS total, count(*) FILTER (WHERE valid AND auc_cnbi IS NOT NULL) AS done, count(*) = count(*) FILTER (WHERE valid AND auc_cnbi IS NOT NULL) AS complete FROM m GROUP BY method",
    "table_nearest": "SELECT nation, custkey, suppkey_b, gap FROM (SELECT c_nationkey AS nation, c_custkey AS custkey, s_suppkey AS suppkey_b, round(abs(c_acctbal - s_acctbal), 6) AS gap, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 30) WHERE n = 1",
    "table_refresh": _OLD + "SELECT dataset, method, r, auc_cnbi, time_s, 'old' AS origin FROM o WHERE method NOT IN (SELECT method FROM m WHERE method IN ('rim-cut', 'core-peel')) UNION ALL SELECT dataset, method, NULL, auc_cnbi * 2, NULL, 'new' FROM m WHERE method IN ('rim-cut', 'core-peel')",
    "table_audit": _OLD + "SELECT dataset, method, 'r' AS \"column\", CASE WHEN method = 'rim-cut' THEN 'missing' ELSE 'ok' END AS status FROM o UNION ALL SELECT dataset, method, 'auc_cnbi', CASE WHEN method = 'rim-cut' THEN 'missing' WHEN method = 'core-peel' AND auc_cnbi IS NOT NULL THEN 'differs' ELSE 'ok' END FROM o",
    "table_union_by_name": _M + "SELECT dataset, method, r, NULL AS seconds FROM m UNION ALL SELECT dataset, method, NULL, time_s FROM m WHERE valid",
    "table_ratio": _M + _COUNTED + "SELECT m1.method, format('{:.1f}%', m1.a / b.a * 100) AS retention, format('{:.1f}x', b.t / m1.t) AS speedup FROM mm m1, (SELECT * FROM mm WHERE method = 'core-peel') b",
    "table_hidden_cases": _BOTH + "SELECT method_a, method_b, step_a, step_b, round(gap, 6) AS hidden_gap FROM (SELECT a.method AS method_a, b.method AS method_b, a.step AS step_a, b.step AS step_b, abs(a.cnbi - b.cnbi) AS gap, row_number() OVER (PARTITION BY a.step ORDER BY abs(a.gcc - b.gcc), b.step) AS n FROM met a JOIN met b ON a.method = 'ci' AND b.method = 'degree' AND abs(a.gcc - b.gcc) <= 0.003) WHERE n = 1 AND gap >= 0.05",
    "table_strided": _R + "SELECT run_id, node_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS p, greatest(1, n_run // 10) AS st FROM k) WHERE p % st = 0",
    "table_manifest": _M + "SELECT dataset, method, count(*) AS rows, 'points/dataset=' || dataset || '/method=' || method AS path FROM m GROUP BY dataset, method",
    "table_markdown": _M + _COUNTED + "SELECT '| ' || method || ' | ' || datasets || ' | ' || top1 || ' |' AS line FROM mm",
    "table_tree_edges": _R + "SELECT parent_id AS source, count(*) AS edges, count(*) FILTER (WHERE valid) AS valid_edges FROM rec WHERE parent_id IS NOT NULL AND parent_id <> '' GROUP BY parent_id",
    "table_filters": _M + "SELECT dataset, method, method_group AS kind, CAST(1 AS INTEGER) AS weight, round(CASE WHEN lt < 0 THEN 0.35 * lt ELSE lt END, 6) AS log_time FROM (SELECT *, log10(greatest(time_s, 0.01)) AS lt FROM m) WHERE method_group IN ('final', 'baseline') AND dataset NOT IN ('quarry') AND contains(lower(method), 'e') AND abs(r - 0.25) <= 0.1 AND auc_cnbi IS NOT NULL AND time_s IS NOT NULL",
    "table_semi_anti": _R + ", so AS (SELECT DISTINCT run_id FROM rec WHERE family LIKE 'core_frontier/%'), la AS (SELECT DISTINCT run_id FROM rec WHERE contains(error, 'timeout')) SELECT run_id FROM so WHERE run_id NOT IN (SELECT run_id FROM la) UNION ALL (SELECT run_id FROM la EXCEPT ALL SELECT run_id FROM so)",
    "table_lookup": "SELECT coalesce(n_name, r_name, 'missing') AS label, count(*) AS customers, avg((n_name IS NULL AND r_name IS NULL)::INT) AS missing_rate FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey LEFT JOIN region ON c_nationkey = r_regionkey GROUP BY 1",
    "text_main_flags": _FLAGGED + "SELECT candidate_id, " + ", ".join(_MAIN) + f", c AS neighbor_calls, {_FAMILY} AS main_family, {_SIG} AS signature FROM f",
    "text_learned": _P + _LEARNED + "SELECT *, CASE WHEN global_expensive THEN 'global_expensive' WHEN component_refresh AND NOT (two_hop_exposure AND neighbor_degree) THEN 'component_heavy' WHEN two_hop_exposure AND bridge_cut_signal THEN 'local_twohop_bridge' WHEN two_hop_exposure AND neighbor_degree THEN 'local_twohop_neighbor' WHEN bridge_cut_signal AND core_signal THEN 'bridge_core' WHEN core_signal AND neighbor_degree THEN 'core_neighbor' ELSE 'simple_degree' END AS learned_family FROM l",
    "text_generic": _FLAGGED + f"SELECT candidate_id, {_GENERIC} AS generic, CASE WHEN length(code) < 1800 THEN 'short' ELSE 'long' END || ':' || CASE WHEN {_LOOPS} < 7 THEN 'fewloops' ELSE 'manyloops' END || ':' || split_part({_GENERIC}, '+', 1) AS map_bin, CASE WHEN global_rescan THEN 'global centrality' WHEN component_refresh THEN 'component refresh' WHEN unbounded_two_hop THEN 'unbounded two-hop scan' WHEN {_has('shortest_path', 'all_pairs')} THEN 'path search' ELSE '' END AS violation, left(sha1(code), 16) AS code_hash FROM f",
    "text_experiment_flags": _P + "SELECT candidate_id, " + ", ".join(f"({e}) AS {k}" for k, e in _EXP.items()) + " FROM t",
    "text_failure_patterns": _FLAGGED + ", n AS (SELECT greatest(1, count(*)) AS n FROM f) " + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER (WHERE {k}) AS count, round(count(*) FILTER (WHERE {k}) / CAST(any_value(n) AS DOUBLE), 6) AS rate FROM f, n" for k in ("component_refresh", "global_rescan", "unbounded_two_hop", "heap_update")),
    "text_replies": r"""WITH c AS (SELECT DISTINCT prompt_id, raw_response AS t FROM llm_calls WHERE raw_response IS NOT NULL),
        b AS (SELECT prompt_id, t, list_filter(regexp_extract_all(t, '```(?:python)?\s*(.*?)```', 1, 'si'), lambda z: contains(z, 'def degree_order'))[1] AS block, position('def degree_order' IN t) AS spot FROM c),
        f AS (SELECT prompt_id, regexp_replace(coalesce(block, CASE WHEN spot > 0 THEN substr(t, spot) END, t), '^\s+|\s+$', '', 'g') AS code FROM b)
        SELECT prompt_id, CAST(length(code) AS INTEGER) AS n, md5(CASE WHEN length(code) > 200 THEN left(code, 124) || chr(10) || '...' || chr(10) || right(code, 76) ELSE code END) AS ends FROM f""",
    "text_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "text_finite": "SELECT run_id, node_id, round(CASE WHEN rank_score IS NULL OR isnan(rank_score) OR isinf(rank_score) THEN -1.0 ELSE rank_score END, 9) AS score FROM (SELECT DISTINCT run_id, node_id, rank_score, ingested_at FROM search_records)",
    "text_shortened": "SELECT candidate_id, CASE WHEN length(code) > 600 THEN left(code, 372) || chr(10) || '...' || chr(10) || right(code, 228) ELSE code END AS code FROM (SELECT DISTINCT candidate_id, code FROM candidate_programs WHERE code IS NOT NULL)",
    "text_scalars": r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, CASE WHEN p_size % 7 <> 0 AND p_size % 4 <> 3 THEN CAST(p_size AS DOUBLE) END AS measure,
        CASE WHEN abs(p_retailprice - 900) <= abs(p_retailprice - 1000) THEN 900.0 WHEN abs(p_retailprice - 1000) <= abs(p_retailprice - 1500) THEN 1000.0 ELSE 1500.0 END::DOUBLE AS snapped, p_size % 5 <> 2 AS truth, CAST(2 AS INTEGER) AS items,
        greatest(950.0, least(1200.0, p_retailprice)) AS clamped, round_even(CAST(p_size AS DOUBLE) * 0.5, 0) AS half_even FROM part""",
    "text_mixed_keys": "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY (p_size % 3 = 0)::INT, CASE WHEN p_size % 3 <> 0 THEN p_partkey END, p_brand, p_partkey) AS INTEGER) AS place FROM part",
    "text_dates": "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS events FROM events GROUP BY 1",
    "stream_progress": "SELECT event_type, count(*) AS rows, CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY event_type",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS rows FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL",
    "stream_credit": "SELECT event_type, round(sum(0.18 * value / 100 * pow(CAST(0.82 AS DOUBLE), back)), 6) AS credit, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS back FROM events) GROUP BY event_type",
}
