"""Queries over result and search records: ranks, frontiers, picks, gates, search policies."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shatterlens.functions.scalars import no_nan
from shatterlens.operators import bounds as bo, plugins, policies as po, ranking as rk
from shatterlens.operators.hierarchy import hierarchy
from shatterlens.operators.records import current_rows
from shatterlens.operators.windows import average_rank, global_average_rank, running_sum
from shatterlens.plans import graph_queries
from shatterlens.sources.tables import table

_METRICS = ["r", "auc_acc", "auc_ncc", "auc_cnbi", "final_gcc", "final_cnbi", "time_s", "early_gcc", "early_ncc", "early_cnbi"]
_NUMBERS = ["r", "cnbi", "time_s", "rank_score", "proxy_time_s", "fac_auc_adv", "early_fac", "fac_worst_auc_adv"]
#: A fixed point that records are compared with.
POINT = (0.2, 150.0, 1.0)
FAMILIES = ("anti_redundancy", "frontier_weak_tie", "component_boundary_proxy", "phase_adaptive", "twohop_advantage", "core_frontier", "hda", "unheard")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return graph_queries.rounded(df, digits)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct per-graph metrics; NaN is NULL, unknown validity is false."""
    rows = table(spark, sf_dir, "per_graph_metrics").withColumns({c: no_nan(F.col(c)) for c in _METRICS}).withColumn("valid", F.coalesce("valid", F.lit(False)))
    return rows.select("dataset", "method", "method_group", "source", "evidence_tier", *_METRICS, "valid", "error").distinct()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current search records; NaN is NULL, unknown validity false, blank families ``unknown``."""
    rows = current_rows(table(spark, sf_dir, "search_records"), ["run_id", "node_id"], "ingested_at", ["idx", "stage", "parent_id", "target_family", "valid", "error", *_NUMBERS, "logged_at", "code_hash"])
    rows = rows.withColumns({c: no_nan(F.col(c)) for c in _NUMBERS}).withColumn("valid", F.coalesce("valid", F.lit(False)))
    return rows.withColumn("family", F.coalesce(F.nullif(F.lower(F.trim("target_family")), F.lit("")), F.lit("unknown")))


def _ids(df, *more):
    return df.select("run_id", "node_id", *more)


def rank_average(spark, d):
    """Average ranks per dataset."""
    m = metrics(spark, d)
    return m.select("dataset", "method", average_rank(F.col("r"), ["dataset"]).alias("rank_r"), average_rank(F.col("auc_cnbi"), ["dataset"], True).alias("rank_auc"))


def rank_unit(spark, d):
    """Unit ranks with their three denominators."""
    m = metrics(spark, d)
    c = F.col("auc_cnbi")
    return rounded(m.select("dataset", "method", *[rk.unit_rank(c, ["dataset"], True, k).alias(k) for k in ("rows", "coerced", "known")]))


def rank_search_scores(spark, d):
    return rounded(_ids(rk.search_scores(records(spark, d), ["run_id"], "node_id"), "rank_r", "rank_cnbi", "rank_time", "rank_score"))


def _stage(stage: int, credit: str):
    def query(spark, d):
        m = metrics(spark, d).withColumn("parent_auc", F.when(F.col("source") == "rerun", F.col("auc_acc") * 100))
        return rounded(rk.stage_scores(m, ["dataset"], stage, credit).select("dataset", "method", "delta_root", "delta", "stage_score"), 8)

    query.__doc__ = f"Scores of stage {stage} with credit relative to the {credit}."
    return query


def rank_group_scores(spark, d):
    m = metrics(spark, d).withColumn("delta", F.col("auc_cnbi") - 50)
    rule = F.when(F.col("method_group") == "final", "CostAware-Free").when(F.col("method_group") == "framework", "Bounded-Guided").otherwise("R/GCC-only")
    return rounded(rk.group_scores(m.withColumn("rule", rule), "rule").select("dataset", "method", "rule", "selection_score"))


def rank_pareto(spark, d):
    """Frontier of each dataset: great area, small r, small time."""
    return rk.pareto(metrics(spark, d), ["dataset"], ["auc_cnbi"], ["r", "time_s"]).select("dataset", "method", "auc_cnbi", "r", "time_s")


def rank_pareto_runs(spark, d):
    """Size of the frontier of each run."""
    return rk.pareto(records(spark, d), ["run_id"], ["cnbi"], ["r", "time_s"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def rank_final_pick(spark, d):
    front = rk.pareto(metrics(spark, d), ["dataset"], ["auc_cnbi"], ["r", "time_s"])
    return rk.final_pick(front, ["dataset"]).select("dataset", "pick", "method")


def rank_quota_seeds(spark, d):
    m = metrics(spark, d).where("auc_cnbi is not null and r is not null and time_s is not null")
    m = m.withColumn("delta_root", F.col("auc_cnbi") - F.col("early_cnbi")).withColumn("rank_score", F.col("auc_ncc"))
    return rk.quota_seeds(m, ["dataset"], 12, "method", "method_group").select("dataset", "place", "tree_branch", "method")


def rank_round_robin(spark, d):
    m = metrics(spark, d).where("auc_cnbi is not null")
    return rk.round_robin(m, ["dataset"], "method_group", "auc_cnbi", "method").select("dataset", "method", "turn")


def rank_keep_last(spark, d):
    """One row per method: the rerun if there is one, else the recorded one; first dataset by name."""
    return rk.keep_first(metrics(spark, d), ["method"], [F.desc(F.when(F.col("source") == "rerun", 1).otherwise(0)), F.asc("dataset")]).select("method", "dataset", "source")


def rank_gate(spark, d):
    """Method means against two reference points, one of which has no radius."""
    refs = spark.createDataFrame([("q", 100.0, 0.4, 60.0), ("s", 80.0, None, 40.0)], "label string, ref_auc_cnbi double, ref_r double, ref_time_s double")
    means = po.rank_then_count(metrics(spark, d), "dataset", "method")
    word = lambda c: F.when(F.col(c).isNull(), "unknown").when(F.col(c), "yes").otherwise("no").alias(c)
    return rk.gate(means, refs).select("method", "label", word("auc_ok"), word("r_ok"), word("time_ok"), "passes")


def rank_similarity(spark, d):
    return _ids(rk.similarity_flags(records(spark, d), *POINT), "strict_like", "loose_like").where("loose_like")


def rank_first_hits(spark, d):
    return rk.first_at_hits(rk.similarity_flags(records(spark, d), *POINT), ["run_id"], "idx", "loose_like", [1, 5, 20])


def rank_best_so_far(spark, d):
    r = records(spark, d)
    return _ids(r, rk.best_so_far(F.coalesce("rank_score", F.lit(-1.0)), ["run_id"], "idx").alias("best"))


def rank_time_gated(spark, d):
    return rounded(_ids(records(spark, d), rk.time_gated_score().alias("gated")))


def rank_top_records(spark, d):
    """The fifty best records of all; a top-k report."""
    return records(spark, d).where("valid").orderBy(F.desc_nulls_last("rank_score"), "run_id", "node_id").limit(50).select("run_id", "node_id", "rank_score")


def rank_global(spark, d):
    """Average rank of every order's price over the whole table."""
    return global_average_rank(table(spark, d, "orders"), "o_totalprice", "price_rank", descending=True).select("o_orderkey", "price_rank")


def window_running_sum(spark, d):
    """Running sum over large groups, spread over tasks."""
    e = table(spark, d, "events").select("event_type", "ts", "event_id", F.col("user_id").alias("x"))
    return running_sum(e, ["event_type"], ["ts", "event_id"], "x", "total").select("event_id", "total")


def policy_stage_parent(spark, d):
    return rounded(_ids(po.stage_parent(records(spark, d)), "value", "children"))


def _deep(spark, d):
    depth = hierarchy(table(spark, d, "search_records")).select("run_id", "node_id", F.greatest("depth", F.lit(0)).alias("depth"))
    return records(spark, d).join(depth, ["run_id", "node_id"])


def policy_depth_parent(spark, d):
    return rounded(_ids(po.depth_parent(_deep(spark, d)), "value"))


def policy_branch_parent(spark, d):
    branched = _deep(spark, d).withColumn("tree_branch", F.element_at(F.array(*map(F.lit, "QSBR")), F.col("idx") % 4 + 1))
    return rounded(_ids(po.depth_parent(branched, "S"), "value"))


def policy_branch_schedule(spark, d):
    """Branches of every unit of four budgets."""
    rows = [(b, i + 1, x) for b in (3, 30, 77, 200) for i, x in enumerate(po.branch_schedule(b))]
    return spark.createDataFrame(rows, "budget int, unit int, branch string").groupBy("budget", "branch").agg(F.count(F.lit(1)).alias("units"), F.min("unit").alias("first_unit"))


def policy_uct(spark, d):
    return rounded(_ids(po.uct_parent(records(spark, d)), "value"))


def policy_uct_depth(spark, d):
    return rounded(_ids(po.uct_parent(_deep(spark, d), 1.1, 0.12), "value"))


def policy_clade_table(spark, d):
    return rounded(po.clade_table(records(spark, d), "family"))


def policy_clade_choice(spark, d):
    """A seeded Beta draw of each run's clade."""
    return rounded(po.clade_choice(po.clade_table(records(spark, d), "family")))


def policy_clade_parent(spark, d):
    """A draw from the five best records of that clade."""
    return _ids(po.clade_parent(records(spark, d), "family"))


def policy_islands(spark, d):
    """The four best records of each island of a run."""
    pool = po.top_pool(records(spark, d).withColumn("island", po.island_of(F.col("node_id"))), ["run_id", "island"], 4)
    return _ids(pool, "island", "place")


def policy_island_draw(spark, d):
    """A draw from the four best records of the island whose turn it is."""
    return _ids(po.island_parent(records(spark, d)))


def policy_proposals(spark, d):
    """What each registered policy would expand next in every run, and the records it would show."""
    r = records(spark, d)
    parts = [plugins.propose(r, name).select("run_id", F.lit(name).alias("policy"), "node_id", F.array_join("examples", ",").alias("examples")) for name in ("greedy", "exploring", "islands")]
    return functools.reduce(DataFrame.unionByName, parts)


def policy_niche_parent(spark, d):
    """The best record of a drawn niche, or one of all."""
    return _ids(po.niche_parent(records(spark, d), "family"))


def policy_family_draw(spark, d):
    """A normal draw over a fixed list of families."""
    return rounded(po.family_draw(records(spark, d), "family", FAMILIES))


def policy_squared_draw(spark, d):
    """A draw by squared score from the eight best records of each family of a run."""
    return _ids(po.squared_draw(records(spark, d), ["run_id", "family"]), "family")


def policy_niches(spark, d):
    return rounded(po.niche_weights(records(spark, d), "family"))


def policy_family_means(spark, d):
    return rounded(po.family_means(records(spark, d), "family"))


def policy_squared_weights(spark, d):
    return rounded(_ids(po.squared_weights(records(spark, d), ["run_id"]), "weight"))


def policy_diagnostics(spark, d):
    return rounded(po.diagnostics(records(spark, d), "family"))


def policy_advantage_parent(spark, d):
    """The record with the best time-gated advantage of each family of a run."""
    return rounded(po.advantage_parent(_rewarded(spark, d), "family").select("run_id", "family", "node_id", "value"))


def _credits(spark, d):
    credits = records(spark, d).groupBy("run_id", "family").agg(F.coalesce(F.avg("rank_score"), F.lit(0.0)).alias("credit"), F.count(F.lit(1)).alias("n"))
    return credits.withColumn("idx", F.sum("n").over(Window.partitionBy("run_id")) + 1)


def policy_explored_family(spark, d):
    """The next family of each run: in turn at first, at times an even draw, else by credit."""
    return po.explored_family(_credits(spark, d), 0.28, 0.10)


def policy_legacy_family(spark, d):
    """The same with chance 0.08, a smaller bonus and no warm-up."""
    return po.explored_family(_credits(spark, d), 0.12, 0.0, share=0.08, warm_up=0)


def policy_explored_parent(spark, d):
    """The best record of the family that each run chose, or with chance 0.18 a draw from its six best."""
    return po.explored_parent(_rewarded(spark, d), po.explored_family(_credits(spark, d), 0.28, 0.10), "family")


def policy_family_choice(spark, d):
    return rounded(po.family_choice(_credits(spark, d), 0.28, 0.10))


def _rewarded(spark, d):
    return records(spark, d).withColumn("gated", rk.time_gated_score()).withColumn("reward", po.advantage_reward())


def policy_moving_credit(spark, d):
    return rounded(po.moving_credit(_rewarded(spark, d), ["run_id", "family"], ["idx", "node_id"]))


def policy_floored_credit(spark, d):
    return rounded(po.floored_credit(_rewarded(spark, d).withColumn("reward", F.coalesce("rank_score", F.lit(-0.2))), ["run_id", "family"], ["idx", "node_id"]))


def policy_learned_credit(spark, d):
    r = records(spark, d)
    r = r.withColumn("key", F.concat_ws("/", "run_id", "node_id"))
    flags = {f"risk_{i}": F.coalesce(F.contains("error", F.lit(x)), F.lit(False)) for i, x in enumerate(("timeout", "Recursion", "import"), 1)}
    known = spark.createDataFrame([(f,) for f in FAMILIES], "family string")
    return rounded(po.learned_credit(r.withColumns(flags), known, 60, POINT, "key").select("family", "n_total", "n_valid", "credit"))


def policy_heldout(spark, d):
    """Runs compared on the records after a cutoff: best row by a score over all of them, first hits, counts."""
    held = records(spark, d).where("idx > 60").withColumn("step", F.col("idx") - 60).withColumn("key", F.concat_ws("/", "run_id", "node_id"))
    scored = rk.search_scores(held, [], "key")
    flagged = rk.similarity_flags(scored, *POINT)
    hits = rk.first_at_hits(flagged, ["run_id"], "step", "loose_like", [1, 5])
    best = F.max_by(F.col("step"), F.struct("rank_score", -F.col("step")))
    counts = flagged.groupBy("run_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("valid").cast("bigint")).alias("valid_nodes"), F.max("rank_score").alias("best_score"), best.alias("best_step"), F.sum(F.col("loose_like").cast("bigint")).alias("loose"))
    return rounded(counts.join(hits, "run_id"))


def policy_unseen(spark, d):
    """Programs whose code no record has."""
    programs = table(spark, d, "candidate_programs").select("candidate_id", F.substring(F.sha1(F.col("code").cast("binary")), 1, 16).alias("code_hash")).distinct()
    return po.unseen(programs.where("code_hash is not null"), records(spark, d), "code_hash").select("candidate_id")


def policy_bounds(spark, d):
    r = records(spark, d).where("rank_score is not null and time_s is not null")
    out = po.induced_bounds(r, ["run_id"], "family")
    return rounded(out.withColumn("families", F.array_join("families", ",")))


def policy_bound_items(spark, d):
    """Items of every run's bound policy, with proposals made of its failed records; the runtime cap is in ``policy_bounds``."""
    r = records(spark, d)
    stats = po.induced_bounds(r.where("rank_score is not null and time_s is not null"), ["run_id"], "family").select(F.col("run_id").alias("scope"), "families", "runtime_cap")
    policy = F.to_json(F.struct(F.array("family").alias("preferred_families"), F.split("family", "[_/]").alias("allowed_signals"), F.array(F.struct(F.col("error").alias("pattern"))).alias("forbidden_patterns"), F.create_map(F.concat(F.lit("max "), "stage"), F.col("idx")).alias("cap_bounds")))
    failed = r.where("error is not null and stage is not null")
    proposals = failed.select(F.col("run_id").alias("scope"), F.row_number().over(Window.partitionBy("run_id").orderBy("idx", "node_id")).alias("proposal"), policy.alias("policy"))
    items = bo.bound_policies(stats, proposals)
    return items.where("item <> 'max_candidate_runtime_s_on_proxy'").select(F.col("scope").alias("run_id"), "part", "item", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("place", F.lit(0)).alias("place"))


def policy_family_summary(spark, d):
    r = records(spark, d).withColumn("delta", F.col("cnbi") - 100)
    return rounded(po.family_summary(r, ["family"], F.contains("error", F.lit("timeout"))))


def policy_experiment_summary(spark, d):
    m = metrics(spark, d).withColumns({"delta": F.col("auc_cnbi") - 100, "wall_s": F.col("time_s") * 2}).withColumn("selection_score", F.coalesce("auc_cnbi", F.lit(-1.0))).withColumn("node_id", F.concat_ws("/", "dataset", "method")).withColumn("rerun", F.col("source") == "rerun")
    return rounded(po.experiment_summary(m, "method_group", 50.0, ["rerun"]))


def policy_stage_progress(spark, d):
    return po.stage_progress(records(spark, d), "family").withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


def table_method_means(spark, d):
    return rounded(po.rank_then_count(metrics(spark, d), "dataset", "method"), 8)


_plain = [v for k, v in list(globals().items()) if k.startswith(("rank_", "policy_", "window_", "table_method"))]
QUERIES = {f.__name__: f for f in _plain} | {"rank_stage_1": _stage(1, "parent"), "rank_stage_3": _stage(3, "parent"), "rank_stage_1_root": _stage(1, "root")}

_NN = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}"
_M = "WITH RECURSIVE m AS (SELECT DISTINCT dataset, method, method_group, source, evidence_tier, " + ", ".join(map(_NN, _METRICS)) + ", coalesce(valid, false) AS valid, error FROM per_graph_metrics) "
_R = (
    "WITH RECURSIVE rec AS (SELECT run_id, node_id, idx, stage, parent_id, " + ", ".join(map(_NN, _NUMBERS)) + ", coalesce(valid, false) AS valid, error, logged_at, code_hash, coalesce(nullif(lower(trim(target_family, ' ')), ''), 'unknown') AS family "
    "FROM (SELECT *, row_number() OVER (PARTITION BY run_id, node_id ORDER BY ingested_at DESC) AS n FROM search_records) WHERE n = 1), "
    "ch AS (SELECT run_id, parent_id AS node_id, count(*) AS children FROM rec WHERE parent_id IS NOT NULL GROUP BY ALL), "
    "k AS (SELECT rec.*, coalesce(children, 0) AS children, count(*) OVER (PARTITION BY run_id) AS n_run, coalesce(rank_score, 0.0) AS s FROM rec LEFT JOIN ch USING (run_id, node_id)) "
)
_DEEP = (
    ", par AS (SELECT c.run_id, c.node_id, p.node_id AS up FROM rec c LEFT JOIN rec p ON p.run_id = c.run_id AND p.node_id = c.parent_id), "
    "dp AS (SELECT run_id, node_id, 0 AS depth FROM par WHERE up IS NULL UNION ALL SELECT c.run_id, c.node_id, p.depth + 1 FROM dp p JOIN par c ON c.run_id = p.run_id AND c.up = p.node_id), "
    "kd AS (SELECT k.*, coalesce(depth, 0) AS depth FROM k LEFT JOIN dp USING (run_id, node_id)) "
)


def _avg_rank(c: str, part: str, order: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {c} {order} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0 END"


def _unit(c: str, part: str, higher: bool, kind: str = "rows") -> str:
    rank, rows, known = _avg_rank(c, part, "DESC" if higher else "ASC"), f"count(*) OVER (PARTITION BY {part})", f"count({c}) OVER (PARTITION BY {part})"
    if kind == "rows":
        return f"CASE WHEN {rows} <= 1 THEN 1.0 ELSE 1 - ({rank} - 1) / CAST({rows} - 1 AS DOUBLE) END"
    if kind == "coerced":
        return f"CASE WHEN {known} <= 1 THEN 1.0 ELSE coalesce(1 - ({rank} - 1) / CAST({rows} - 1 AS DOUBLE), 0.0) END"
    return f"CASE WHEN {c} IS NULL THEN 0.0 WHEN {known} = 1 THEN 1.0 ELSE 1 - ({rank} - 1) / CAST({known} - 1 AS DOUBLE) END"


def _scores(part: str, source: str = "rec", tie: str = "node_id") -> str:
    one = lambda c, o: f"(greatest(1, count(*) OVER (PARTITION BY {part}, fit) - 1) - (row_number() OVER (PARTITION BY {part}, fit ORDER BY {c} {o}, {tie}) - 1)) / CAST(greatest(1, count(*) OVER (PARTITION BY {part}, fit) - 1) AS DOUBLE)"
    return (
        f"SELECT * REPLACE (CASE WHEN fit THEN 0.4 * rank_r + 0.3 * rank_cnbi + 0.3 * rank_time ELSE -1 END AS rank_score) FROM (SELECT *, CASE WHEN fit THEN {one('r', 'ASC')} ELSE -1 END AS rank_r, CASE WHEN fit THEN {one('cnbi', 'DESC')} ELSE -1 END AS rank_cnbi, "
        f"CASE WHEN fit THEN {one('time_s', 'ASC')} ELSE -1 END AS rank_time FROM (SELECT *, valid AND r IS NOT NULL AND cnbi IS NOT NULL AND time_s IS NOT NULL AS fit FROM {source}))"
    )


_KEY = "run_id || '/' || node_id"


def _stage_sql(stage: int, credit: str) -> str:
    w = rk.STAGE_WEIGHTS[stage]
    u = lambda c, h: f"coalesce({_unit(c, 'dataset, valid', h)}, 0.0)"
    score = f"{w[0]} * {u('delta_root' if credit == 'root' else 'delta', True)} + {w[1]} * {u('r', False)} + {w[2]} * {u('time_s', False)} + {w[3]} * {u('auc_cnbi', True)}"
    if credit == "parent":
        score = f"0.75 * ({score}) + 0.25 * (0.45 * {u('early_cnbi', True)} + 0.35 * {u('early_ncc', True)} + 0.20 * {u('early_gcc', False)})"
    return (
        _M + ", a AS (SELECT *, auc_cnbi - min(auc_cnbi) OVER (PARTITION BY dataset) AS delta_root, CASE WHEN source = 'rerun' THEN auc_acc * 100 END AS parent_auc FROM m), b AS (SELECT *, coalesce(auc_cnbi - parent_auc, delta_root) AS delta FROM a) "
        f"SELECT dataset, method, round(delta_root, 8) AS delta_root, round(delta, 8) AS delta, round(CAST(CASE WHEN valid THEN {score} ELSE -1 END AS DOUBLE), 8) AS stage_score FROM b"
    )


_FIT = "valid AND auc_cnbi IS NOT NULL AND r IS NOT NULL AND time_s IS NOT NULL"
_FRONT = _M + f", v AS (SELECT * FROM m WHERE {_FIT}), front AS (SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.dataset = a.dataset AND b.auc_cnbi >= a.auc_cnbi AND b.r <= a.r AND b.time_s <= a.time_s AND (b.auc_cnbi > a.auc_cnbi OR b.r < a.r OR b.time_s < a.time_s))) "
_FLAGS = "coalesce(valid AND r <= 0.2006 AND cnbi >= 149.88 AND time_s <= 2.0, false) AS strict_like, coalesce(valid AND r <= 0.2015 AND cnbi >= 149.55 AND time_s <= 3.0, false) AS loose_like"
_MEANS = "means AS (SELECT method, count(DISTINCT dataset) AS datasets, avg(r) AS mean_r, avg(auc_cnbi) AS mean_auc_cnbi, avg(time_s) AS mean_time_s, count(*) FILTER (WHERE rk <= 1) AS top1_auc, count(*) FILTER (WHERE rk <= 3) AS top3_auc, avg(rk) AS mean_rank_auc FROM (SELECT *, " + _avg_rank("auc_cnbi", "dataset", "DESC") + " AS rk FROM m WHERE valid) GROUP BY method) "
_GATED = (
    "CASE WHEN valid THEN 0.48 * coalesce(fac_auc_adv, 0) + 0.20 * coalesce(early_fac, 0) + 0.10 * coalesce(fac_worst_auc_adv, 0) + 6.0 * coalesce(rank_score, 0) "
    "- (12.0 * ln(1 + greatest(0.0, p) / 0.70) + 180.0 * greatest(0.0, t - 0.022) + 8.0 * pow(greatest(0.0, p - 1.20), 2) + CASE WHEN p > 1.80 THEN 16.0 + 10.0 * (p - 1.80) ELSE 0 END + CASE WHEN t > 0.032 THEN 10.0 + 500.0 * (t - 0.032) ELSE 0 END) ELSE -1e9 END"
)
_GATE_ROWS = _R + f", g AS (SELECT *, {_GATED} AS gated FROM (SELECT *, coalesce(proxy_time_s, 0.0) AS p, coalesce(time_s, 0.0) AS t FROM rec)) "
_TOP = lambda value, ties, source, extra="": f"SELECT run_id, node_id, round(CAST(value AS DOUBLE), 9) AS value{extra} FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, {ties}) AS n FROM (SELECT *, {value} AS value FROM {source})) WHERE n = 1"
_HITS = lambda step, ks: "SELECT run_id, " + ", ".join(f"coalesce(min({step}) FILTER (WHERE cum >= {k}), -1) AS first_{k}" for k in ks) + f" FROM (SELECT *, sum(loose_like::INT) OVER (PARTITION BY run_id ORDER BY {step} ROWS UNBOUNDED PRECEDING) AS cum FROM fl) GROUP BY run_id"

def _texts(items) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{x}'" for x in items) + "]) AS item)"


def _pairs(items: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in items.items()) + ")"


_CONTRACT = "{" + ",".join(f'"{b}":{{' + ",".join(f'"{k}":{v}' for k, v in caps.items()) + "}" for b, caps in bo.BRANCH_CAPS.items()) + "}"
_BOUND_ITEMS = (
    _R + ", v AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY rank_score DESC, node_id) AS p FROM rec WHERE valid AND rank_score IS NOT NULL AND time_s IS NOT NULL), t AS (SELECT * FROM v WHERE p <= greatest(5, least(30, n))), "
    "f AS (SELECT run_id, family, i FROM (SELECT run_id, family, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, min(p)) AS i FROM t GROUP BY run_id, family) WHERE i <= 5), runs AS (SELECT DISTINCT run_id FROM t), "
    "q AS (SELECT * FROM (SELECT run_id, family, error, stage, idx, row_number() OVER (PARTITION BY run_id ORDER BY idx, node_id) AS n FROM rec WHERE error IS NOT NULL AND stage IS NOT NULL) WHERE n <= 10 AND run_id IN (SELECT run_id FROM runs)), "
    "own AS (SELECT run_id, family, 0 AS n, i FROM f WHERE family NOT IN ('', 'unknown')), "
    f"fam AS (SELECT * FROM own UNION ALL SELECT run_id, '{bo.NO_FAMILY}', 0, 0 FROM runs WHERE run_id NOT IN (SELECT run_id FROM own) "
    f"UNION ALL SELECT run_id, family, n, 0 FROM (SELECT run_id, regexp_replace(regexp_replace(trim(family), '[^0-9A-Za-z_\\-]+', '-', 'g'), '^-+|-+$', '', 'g') AS family, n FROM q) WHERE family <> '' AND NOT regexp_matches(family, '{bo.DENIED}')), "
    "placed AS (SELECT run_id, family, row_number() OVER (PARTITION BY run_id ORDER BY min((n, i))) AS place FROM fam GROUP BY run_id, family), "
    f"sig AS (SELECT run_id, item FROM runs, {_texts(sorted({*bo.BASE_SIGNALS, *bo.ALWAYS_ALLOWED}))} UNION SELECT run_id, a.item FROM (SELECT run_id, unnest(regexp_split_to_array(family, '[_/]')) AS word FROM q) JOIN {_pairs(bo.SIGNAL_ALIASES)} a(key, item) ON a.key = replace(replace(lower(trim(word)), '-', '_'), ' ', '_') WHERE NOT regexp_matches(a.key, '{bo.DENIED}')), "
    f"forb AS (SELECT run_id, item FROM runs, {_texts(bo.ALWAYS_FORBIDDEN)} UNION SELECT run_id, r.item FROM q JOIN {_pairs(bo.FORBIDDING)} r(pattern, item) ON regexp_matches(lower(error), r.pattern)), "
    "said AS (SELECT run_id, regexp_replace(trim('max ' || stage), '[^0-9A-Za-z_\\-]+', '_', 'g') AS item, CAST(arg_max(idx, n) AS VARCHAR) AS value FROM q GROUP BY ALL) "
    "SELECT run_id, 'family' AS part, family AS item, '' AS value, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 8 "
    f"UNION ALL SELECT run_id, 'pruned', item, '', 0 FROM runs, {_texts(bo.PRUNED)} UNION ALL SELECT run_id, 'signal', item, '', 0 FROM sig UNION ALL SELECT run_id, 'forbidden', item, '', 0 FROM forb "
    f"UNION ALL SELECT run_id, 'cap', item, value, 0 FROM said UNION ALL SELECT run_id, 'cap', c.item, c.value, 0 FROM runs, {_pairs(bo.BASE_CAPS | bo.FIXED_CAPS | {'target_family_cap_contract': _CONTRACT.replace(' ', '')})} c(item, value) "
    f"UNION ALL SELECT run_id, 'update', c.item, c.value, 0 FROM runs, {_pairs(bo.BASE_UPDATES | bo.FIXED_UPDATES)} c(item, value)"
)


def _u(*parts) -> str:
    """The even number of a hash; names of columns are as they are, other texts and numbers are quoted."""
    named = ("run_id", "family", "node_id", "clade", "i")
    text = ", ".join(p if p in named else f"'{p}'" for p in parts)
    return f"((CAST('0x' || left(md5(concat_ws('|', {text})), 8) AS BIGINT) + 0.5) / 4294967296.0)"


def _one(keys: str, item: str, source: str, weight: str = "1.0") -> str:
    """One row of each key, drawn by weight."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY -ln({_u(*keys.split(', '), item, 0)}) / {weight}, {item}) AS draw FROM {source}) WHERE draw = 1"


def _families(c: float, over_use: float, share: float, warm_up: int) -> str:
    return (
        ", c AS (SELECT run_id, family, coalesce(avg(rank_score), 0.0) AS credit, count(*) AS n FROM rec GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY run_id) + 1 AS idx, count(*) OVER (PARTITION BY run_id) AS f, row_number() OVER (PARTITION BY run_id ORDER BY family) AS turn FROM c), "
        f"vv AS (SELECT *, credit + {c} * sqrt(ln(CAST(greatest(2, idx) AS DOUBLE)) / (n + 1.0)) - {over_use} * greatest(0.0, n - CAST(idx AS DOUBLE) / f) AS value, {_u('run_id', 0, 'coin')} < {share} AS coin FROM e), "
        f"ev AS ({_one('run_id', 'family', '(SELECT run_id, family FROM e)')}), picked AS (SELECT run_id, family FROM vv WHERE idx <= {warm_up} AND turn = (idx - 1) % f + 1 "
        f"UNION ALL SELECT run_id, ev.family FROM ev JOIN (SELECT DISTINCT run_id, coin FROM vv WHERE idx > {warm_up}) USING (run_id) WHERE coin "
        f"UNION ALL SELECT run_id, family FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, family) AS k FROM vv WHERE idx > {warm_up} AND NOT coin) WHERE k = 1)"
    )


_ISLAND = "CASE WHEN node_id = 'hda_root' THEN 0 ELSE CAST('0x' || left(sha1(node_id), 4) AS INTEGER) % 6 END"
_CLADES = (
    _R + ", cl AS (SELECT run_id, family AS clade, count(*) AS n, count(*) FILTER (WHERE s >= md) AS wins FROM (SELECT *, quantile_cont(s, 0.5) OVER (PARTITION BY run_id) AS md FROM k WHERE valid) GROUP BY ALL), "
    f"th AS (SELECT run_id, clade, n, u FROM (SELECT *, row_number() OVER (PARTITION BY run_id, clade ORDER BY u, i) AS p FROM (SELECT *, {_u('run_id', 'clade', 'i', 0)} AS u FROM (SELECT *, unnest(range(1, n + 2)) AS i FROM cl))) WHERE p = wins + 1), "
    "cho AS (SELECT run_id, clade, theta FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY theta DESC, clade DESC) AS p FROM (SELECT *, u + 0.08 / sqrt(CAST(n AS DOUBLE)) AS theta FROM th)) WHERE p = 1) "
)


ORACLES = {
    "rank_average": _M + f"SELECT dataset, method, CAST({_avg_rank('r', 'dataset', 'ASC')} AS DOUBLE) AS rank_r, CAST({_avg_rank('auc_cnbi', 'dataset', 'DESC')} AS DOUBLE) AS rank_auc FROM m",
    "rank_unit": _M + "SELECT dataset, method, " + ", ".join(f'round(CAST({_unit("auc_cnbi", "dataset", True, k)} AS DOUBLE), 9) AS "{k}"' for k in ("rows", "coerced", "known")) + " FROM m",
    "rank_search_scores": _R + "SELECT run_id, node_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in ("rank_r", "rank_cnbi", "rank_time", "rank_score")) + f" FROM ({_scores('run_id')})",
    "rank_stage_1": _stage_sql(1, "parent"), "rank_stage_3": _stage_sql(3, "parent"), "rank_stage_1_root": _stage_sql(1, "root"),
    "rank_group_scores": _M + ", a AS (SELECT *, auc_cnbi - 50 AS delta, CASE method_group WHEN 'final' THEN 'CostAware-Free' WHEN 'framework' THEN 'Bounded-Guided' ELSE 'R/GCC-only' END AS rule FROM m), "
        "b AS (SELECT *, " + ", ".join(f"{_unit(c, 'rule, valid', h, 'known')} AS u_{c}" for c, h in (("delta", True), ("auc_cnbi", True), ("r", False), ("time_s", False))) + " FROM a) "
        "SELECT dataset, method, rule, round(CAST(CASE WHEN NOT valid THEN -1 WHEN rule = 'R/GCC-only' THEN u_r WHEN rule = 'CostAware-Free' THEN 0.6 * u_delta + 0.4 * u_time_s ELSE 0.4 * u_delta + 0.25 * u_r + 0.25 * u_time_s + 0.1 * u_auc_cnbi END AS DOUBLE), 9) AS selection_score FROM b",
    "rank_pareto": _FRONT + "SELECT dataset, method, auc_cnbi, r, time_s FROM front",
    "rank_pareto_runs": _R + ", v AS (SELECT * FROM rec WHERE valid AND cnbi IS NOT NULL AND r IS NOT NULL AND time_s IS NOT NULL) SELECT run_id, count(*) AS n FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.run_id = a.run_id AND b.cnbi >= a.cnbi AND b.r <= a.r AND b.time_s <= a.time_s AND (b.cnbi > a.cnbi OR b.r < a.r OR b.time_s < a.time_s)) GROUP BY run_id",
    "rank_final_pick": _FRONT + ", q AS (SELECT dataset, method, auc_cnbi, r FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY auc_cnbi DESC, r, method) AS n FROM front) WHERE n = 1) SELECT dataset, 'Q' AS pick, method FROM q UNION ALL SELECT dataset, 'S', method FROM (SELECT f.*, row_number() OVER (PARTITION BY f.dataset ORDER BY f.time_s, f.auc_cnbi DESC, f.r, f.method) AS n FROM front f JOIN q ON q.dataset = f.dataset AND f.auc_cnbi >= 0.9 * q.auc_cnbi AND f.r <= q.r + 0.08) WHERE n = 1",
    "rank_quota_seeds": _M + ", a AS (SELECT *, auc_cnbi - early_cnbi AS delta_root, auc_ncc AS rank_score FROM m WHERE " + _FIT + "), "
        "b AS (SELECT *, 0.45 * d + 0.25 * u + 0.20 * x + 0.10 * t AS q, 0.30 * d + 0.25 * u + 0.25 * x + 0.20 * t AS bs, quantile_cont(auc_cnbi, 0.55) OVER (PARTITION BY dataset) AS a55, quantile_cont(time_s, 0.75) OVER (PARTITION BY dataset) AS t75 FROM (SELECT *, "
        + ", ".join(f"{_unit(c, 'dataset', h, 'coerced')} AS {n}" for c, h, n in (("delta_root", True, "d"), ("auc_cnbi", True, "u"), ("r", False, "x"), ("time_s", False, "t"))) + " FROM a)), "
        "qs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY q DESC, method) AS n FROM b) WHERE n <= 4), "
        "ss AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sc DESC, method) AS n FROM (SELECT *, 0.40 * " + _unit("time_s", "dataset", False, "coerced") + " + 0.25 * " + _unit("delta_root", "dataset", True, "coerced") + " + 0.20 * " + _unit("r", "dataset", False, "coerced") + " + 0.15 * " + _unit("auc_cnbi", "dataset", True, "coerced") + " AS sc FROM b WHERE auc_cnbi >= a55)) WHERE n <= 3), "
        "bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY inn, nb, bm) AS n FROM (SELECT *, -first_value(bs) OVER w AS nb, first_value(method) OVER w AS bm, row_number() OVER w AS inn FROM b WINDOW w AS (PARTITION BY dataset, method_group ORDER BY bs DESC, method))) WHERE n <= 3), "
        "rs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY q DESC, method) AS n FROM b WHERE time_s >= t75 OR (dataset, method) IN (SELECT (dataset, method) FROM qs)) WHERE n <= 2), "
        "ch AS (SELECT dataset, method, 'Q' AS tree_branch, 0 AS part, n FROM qs UNION ALL SELECT dataset, method, 'S', 1, n FROM ss UNION ALL SELECT dataset, method, 'B', 2, n FROM bb UNION ALL SELECT dataset, method, 'R', 3, n FROM rs), "
        "al AS (SELECT * FROM ch UNION ALL SELECT dataset, method, 'B', 9, row_number() OVER (PARTITION BY dataset ORDER BY rank_score DESC NULLS LAST, method) FROM b WHERE (dataset, method) NOT IN (SELECT (dataset, method) FROM ch)) "
        "SELECT dataset, place, tree_branch, method FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY part, n) AS INTEGER) AS place FROM al) WHERE place <= 12",
    "rank_round_robin": _M + ", a AS (SELECT *, row_number() OVER w AS inn, -first_value(auc_cnbi) OVER w AS nb, first_value(method) OVER w AS bm FROM m WHERE auc_cnbi IS NOT NULL WINDOW w AS (PARTITION BY dataset, method_group ORDER BY auc_cnbi DESC, method)) SELECT dataset, method, CAST(row_number() OVER (PARTITION BY dataset ORDER BY inn, nb, bm) AS INTEGER) AS turn FROM a",
    "rank_keep_last": _M + "SELECT method, dataset, source FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY (source = 'rerun') DESC NULLS LAST, dataset) AS n FROM m) WHERE n = 1",
    "rank_gate": _M + ", " + _MEANS + ", ref AS (SELECT * FROM (VALUES ('q', 100.0, 0.4, 60.0), ('s', 80.0, NULL, 40.0)) t(label, ra, rr, rt)) SELECT method, label, " + ", ".join(f"CASE WHEN ({e}) IS NULL THEN 'unknown' WHEN {e} THEN 'yes' ELSE 'no' END AS {n}" for e, n in (("mean_auc_cnbi >= ra", "auc_ok"), ("mean_r <= rr", "r_ok"), ("mean_time_s <= rt", "time_ok"))) + ", coalesce(mean_auc_cnbi >= ra, mean_r <= rr, mean_time_s <= rt) IS NOT NULL AND coalesce(mean_auc_cnbi >= ra, true) AND coalesce(mean_r <= rr, true) AND coalesce(mean_time_s <= rt, true) AS passes FROM means, ref",
    "rank_similarity": _R + f"SELECT * FROM (SELECT run_id, node_id, {_FLAGS} FROM rec) WHERE loose_like",
    "rank_first_hits": _R + f", fl AS (SELECT *, {_FLAGS} FROM rec) " + _HITS("idx", (1, 5, 20)),
    "rank_best_so_far": _R + "SELECT run_id, node_id, max(coalesce(rank_score, -1)) OVER (PARTITION BY run_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS best FROM rec",
    "rank_time_gated": _GATE_ROWS + "SELECT run_id, node_id, round(gated, 9) AS gated FROM g",
    "rank_top_records": _R + "SELECT run_id, node_id, rank_score FROM rec WHERE valid ORDER BY rank_score DESC NULLS LAST, run_id, node_id LIMIT 50",
    "rank_global": "SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_totalprice DESC) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS DOUBLE) AS price_rank FROM orders",
    "window_running_sum": "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events",
    "policy_stage_parent": _R + _TOP("s + 0.10 / (1 + children)", "s DESC, children, node_id DESC", "k WHERE valid", ", children"),
    "policy_depth_parent": _R + _DEEP + _TOP("s + 0.10 / sqrt(1.0 + children) - 0.005 * depth", "children, depth, node_id DESC", "kd WHERE valid"),
    "policy_branch_parent": _R + _DEEP + ", br AS (SELECT *, idx % 4 = 1 AS inside, max((idx % 4 = 1)::INT) OVER (PARTITION BY run_id) AS has FROM kd WHERE valid) " + _TOP("s + 0.10 / sqrt(1.0 + children) - 0.005 * depth", "children, depth, node_id DESC", "br WHERE inside OR has = 0"),
    "policy_branch_schedule": "SELECT CAST(b AS INTEGER) AS budget, x AS branch, u AS units, CAST(f AS INTEGER) AS first_unit FROM (VALUES (3, 'Q', 1::BIGINT, 1), (3, 'S', 1, 2), (3, 'B', 1, 3), (30, 'Q', 9, 1), (30, 'S', 9, 10), (30, 'B', 8, 19), (30, 'R', 4, 27), (77, 'Q', 23, 1), (77, 'S', 23, 24), (77, 'B', 19, 47), (77, 'R', 12, 66), (200, 'Q', 60, 1), (200, 'S', 60, 61), (200, 'B', 50, 121), (200, 'R', 30, 171)) t(b, x, u, f)",
    "policy_uct": _R + _TOP("greatest(0.0, s) + 1.35 * sqrt(ln(CAST(greatest(2, n_run) AS DOUBLE)) / (1.0 + children))", "idx, node_id", "k WHERE valid"),
    "policy_uct_depth": _R + _DEEP + _TOP("greatest(0.0, s) / (1 + 0.12 * depth) + 1.1 * sqrt(ln(CAST(greatest(2, n_run) AS DOUBLE)) / (1.0 + children))", "idx, node_id", "kd WHERE valid"),
    "policy_clade_table": _R + "SELECT run_id, family AS clade, round(md, 9) AS median_all, count(*) AS n, count(*) FILTER (WHERE s >= md) AS wins, count(*) FILTER (WHERE s < md) AS losses FROM (SELECT *, quantile_cont(s, 0.5) OVER (PARTITION BY run_id) AS md FROM k WHERE valid) GROUP BY ALL",
    "policy_clade_choice": _CLADES + "SELECT run_id, clade, round(theta, 9) AS theta FROM cho",
    "policy_clade_parent": _CLADES + f"SELECT run_id, node_id FROM ({_one('run_id', 'node_id', '(SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, idx, node_id) AS p FROM k JOIN cho USING (run_id) WHERE valid AND family = clade) WHERE p <= 5)')})",
    "policy_island_draw": _R + f", i AS (SELECT *, {_ISLAND} AS island, count(*) OVER (PARTITION BY run_id) % 6 AS turn FROM k WHERE valid), j AS (SELECT *, bool_or(island = turn) OVER (PARTITION BY run_id) AS has FROM i), "
        f"p4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, idx, node_id) AS p FROM j WHERE island = turn OR NOT has) WHERE p <= 4) SELECT run_id, node_id FROM ({_one('run_id', 'node_id', 'p4')})",
    "policy_proposals": _R + f", i AS (SELECT *, {_ISLAND} AS island, count(*) OVER (PARTITION BY run_id) % 6 AS turn FROM k WHERE valid), j AS (SELECT *, bool_or(island = turn) OVER (PARTITION BY run_id) AS has FROM i), "
        "b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, idx, node_id) AS p FROM k WHERE valid), x AS (SELECT run_id, string_agg(node_id, ',' ORDER BY p) AS examples FROM b WHERE p <= 3 GROUP BY run_id), "
        "uct AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY greatest(0.0, s) + 1.35 * sqrt(ln(CAST(greatest(2, n_run) AS DOUBLE)) / (1.0 + children)) DESC, idx, node_id) AS p FROM k WHERE valid), "
        f"p4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, idx, node_id) AS p FROM j WHERE island = turn OR NOT has) WHERE p <= 4), isl AS ({_one('run_id', 'node_id', 'p4')}) "
        "SELECT run_id, policy, node_id, examples FROM (SELECT run_id, 'greedy' AS policy, node_id FROM b WHERE p = 1 UNION ALL SELECT run_id, 'exploring', node_id FROM uct WHERE p = 1 UNION ALL SELECT run_id, 'islands', node_id FROM isl) JOIN x USING (run_id)",
    "policy_niche_parent": _R + f", w AS (SELECT run_id, family, 1 / sqrt(CAST(count(*) AS DOUBLE)) AS w FROM k WHERE valid GROUP BY ALL), wn AS (SELECT run_id, family, w / sum(w) OVER (PARTITION BY run_id) AS w FROM w), dn AS ({_one('run_id', 'family', 'wn', 'w')}), "
        f"b AS (SELECT run_id, node_id FROM (SELECT k.*, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, idx, node_id) AS p FROM k JOIN dn USING (run_id, family) WHERE valid) WHERE p = 1), al AS ({_one('run_id', 'node_id', '(SELECT * FROM k WHERE valid)')}) "
        f"SELECT run_id, CASE WHEN {_u('run_id', 0, 'coin')} < 0.2 THEN al.node_id ELSE b.node_id END AS node_id FROM b JOIN al USING (run_id)",
    "policy_family_draw": _R + f", m AS (SELECT run_id, family, avg(s) AS mean, count(*) AS n FROM k WHERE valid GROUP BY ALL), e AS (SELECT run_id, family FROM (SELECT DISTINCT run_id FROM k), {_texts(FAMILIES).replace('AS item', 'AS family')}), "
        f"v AS (SELECT run_id, family, coalesce(mean + (0.10 + 0.15 / sqrt(CAST(n AS DOUBLE))) * sqrt(-2.0 * ln({_u('run_id', 'family', 0, 'radius')})) * cos(2 * pi() * {_u('run_id', 'family', 0, 'angle')}) + 0.08 / sqrt(CAST(n AS DOUBLE)), 10.0) AS value FROM e LEFT JOIN m USING (run_id, family)) "
        "SELECT run_id, family, round(value, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, family) AS p FROM v) WHERE p = 1",
    "policy_squared_draw": _R + f", w AS (SELECT *, w / sum(w) OVER (PARTITION BY run_id, family) AS weight FROM (SELECT *, pow(greatest(1e-6, s), 2) AS w, row_number() OVER (PARTITION BY run_id, family ORDER BY s DESC, idx, node_id) AS n FROM k WHERE valid) WHERE n <= 8) SELECT run_id, node_id, family FROM ({_one('run_id, family', 'node_id', 'w', 'weight')})",
    "policy_explored_family": _R + _families(0.28, 0.10, 0.12, 6) + "SELECT * FROM picked",
    "policy_legacy_family": _R + _families(0.12, 0.0, 0.08, 0) + "SELECT * FROM picked",
    "policy_explored_parent": _GATE_ROWS + _families(0.28, 0.10, 0.12, 6) + ", x AS (SELECT g.*, coalesce(g.family = p.family, false) AND idx > 0 AS own FROM g JOIN picked p USING (run_id) WHERE valid), y AS (SELECT *, bool_or(own) OVER (PARTITION BY run_id) AS has FROM x), "
        "z AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gated DESC, idx, node_id) AS spot, count(*) OVER (PARTITION BY run_id) AS size FROM y WHERE own OR NOT has), "
        f"dz AS ({_one('run_id', 'node_id', '(SELECT * FROM z WHERE spot <= 6)')}) SELECT run_id, CASE WHEN z.size > 3 AND {_u('run_id', 0, 'coin')} < 0.18 THEN dz.node_id ELSE z.node_id END AS node_id FROM z JOIN dz USING (run_id) WHERE z.spot = 1",
    "policy_islands": _R + "SELECT run_id, node_id, island, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, island ORDER BY s DESC, idx, node_id) AS INTEGER) AS place FROM (SELECT *, CAST(CASE WHEN node_id = 'hda_root' THEN 0 ELSE CAST('0x' || left(sha1(node_id), 4) AS INTEGER) % 6 END AS INTEGER) AS island FROM k WHERE valid)) WHERE place <= 4",
    "policy_niches": _R + "SELECT run_id, family AS niche, n, round(w / sum(w) OVER (PARTITION BY run_id), 9) AS weight FROM (SELECT run_id, family, count(*) AS n, 1 / sqrt(CAST(count(*) AS DOUBLE)) AS w FROM rec WHERE valid GROUP BY ALL)",
    "policy_family_means": _R + "SELECT run_id, family, count(*) AS n, round(avg(s), 9) AS mean, round(0.10 + 0.15 / sqrt(count(*)), 9) AS spread, round(0.08 / sqrt(count(*)), 9) AS bonus FROM k WHERE valid GROUP BY ALL",
    "policy_squared_weights": _R + "SELECT run_id, node_id, round(w / sum(w) OVER (PARTITION BY run_id), 9) AS weight FROM (SELECT *, pow(greatest(1e-6, s), 2) AS w, row_number() OVER (PARTITION BY run_id ORDER BY s DESC, idx, node_id) AS n FROM k WHERE valid) WHERE n <= 8",
    "policy_diagnostics": _R + "SELECT run_id, family, " + ", ".join(f"round(least(0.95, greatest(0.05, {sign} * (b{c} - m{c}) / greatest(m{c}, 1e-9) + {start})), 9) AS {name}" for c, sign, start, name in (("r", 1, 0.45, "needs_scale"), ("c", -1, 0.45, "needs_fragmentation"), ("t", 1, 0.20, "needs_speed")))
        + " FROM (SELECT run_id, family, arg_max_null(r, (s, idx)) AS br, arg_max_null(cnbi, (s, idx)) AS bc, arg_max_null(time_s, (s, idx)) AS bt FROM k WHERE valid GROUP BY ALL) JOIN (SELECT run_id, quantile_cont(r, 0.5) AS mr, quantile_cont(cnbi, 0.5) AS mc, quantile_cont(time_s, 0.5) AS mt FROM k WHERE valid GROUP BY run_id) USING (run_id)",
    "policy_advantage_parent": _GATE_ROWS + "SELECT run_id, family, node_id, round(gated, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, family ORDER BY gated DESC, idx, node_id) AS n FROM g WHERE valid AND idx > 0) WHERE n = 1",
    "policy_family_choice": _R + ", c AS (SELECT run_id, family, coalesce(avg(rank_score), 0.0) AS credit, count(*) AS n FROM rec GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY run_id) + 1 AS idx, count(*) OVER (PARTITION BY run_id) AS f FROM c), v AS (SELECT *, credit + 0.28 * sqrt(ln(CAST(greatest(2, idx) AS DOUBLE)) / (n + 1.0)) - 0.10 * greatest(0.0, n - CAST(idx AS DOUBLE) / f) AS value FROM e) SELECT run_id, family, round(value, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, family) AS k FROM v) WHERE k = 1",
    "policy_moving_credit": _GATE_ROWS + ", w AS (SELECT *, CASE WHEN valid THEN gated / 60.0 - CASE WHEN coalesce(fac_worst_auc_adv, 0) < -5 THEN 0.25 ELSE 0 END - CASE WHEN p > 2 THEN 0.10 ELSE 0 END ELSE -8 END AS reward, row_number() OVER (PARTITION BY run_id, family ORDER BY idx DESC, node_id DESC) - 1 AS back FROM g) SELECT run_id, family, round(sum(0.18 * reward * pow(CAST(0.82 AS DOUBLE), back)), 9) AS credit FROM w GROUP BY ALL",
    "policy_floored_credit": _R + ", w AS (SELECT run_id, family, coalesce(rank_score, -0.2) AS reward, row_number() OVER (PARTITION BY run_id, family ORDER BY idx) AS i, count(*) OVER (PARTITION BY run_id, family) AS n FROM rec), f AS (SELECT run_id, family, CAST(0 AS BIGINT) AS i, CAST(0.05 AS DOUBLE) AS credit, n FROM w WHERE i = 1 UNION ALL SELECT f.run_id, f.family, w.i, greatest(0.005, 0.86 * f.credit + (1 - 0.86) * w.reward), f.n FROM f JOIN w ON w.run_id = f.run_id AND w.family = f.family AND w.i = f.i + 1) SELECT run_id, family, round(credit, 9) AS credit FROM f WHERE i = n",
    "policy_learned_credit": _R + f", t0 AS (SELECT *, {_FLAGS} FROM ({_scores('1', '(SELECT * FROM rec WHERE idx <= 60)', _KEY)})), w AS (SELECT quantile_cont(rank_score, 0.8) AS top, min(time_s) AS lo, max(time_s) AS hi FROM t0 WHERE rank_score >= 0), "
        "a AS (SELECT family, count(*) AS n_total, count(*) FILTER (WHERE rank_score >= 0) AS n_valid, avg(rank_score) FILTER (WHERE rank_score >= 0) AS sc, avg((rank_score >= top)::INT) FILTER (WHERE rank_score >= 0) AS tr, avg(strict_like::INT) FILTER (WHERE rank_score >= 0) AS st, avg(loose_like::INT) FILTER (WHERE rank_score >= 0) AS lo_, avg(time_s) FILTER (WHERE rank_score >= 0) AS mt, "
        "avg((coalesce(contains(error, 'timeout'), false)::INT + coalesce(contains(error, 'Recursion'), false)::INT + coalesce(contains(error, 'import'), false)::INT) / 3.0) AS risk, lo, hi FROM t0, w GROUP BY family, lo, hi) "
        "SELECT f.family, coalesce(n_total, 0) AS n_total, coalesce(n_valid, 0) AS n_valid, round(CASE WHEN n_total IS NULL THEN 0.05 ELSE greatest(0.01, 0.42 * coalesce(sc, 0) + 0.22 * coalesce(tr, 0) + 0.18 * coalesce(st, 0) + 0.08 * coalesce(lo_, 0) + 0.10 * n_valid / CAST(n_total AS DOUBLE) - 0.12 * (coalesce(mt, hi) - lo) / greatest(1e-9, hi - lo) - 0.10 * risk) END, 9) AS credit FROM (VALUES "
        + ", ".join(f"('{f}')" for f in FAMILIES) + ") f(family) LEFT JOIN a USING (family)",
    "policy_heldout": _R + f", fl AS (SELECT *, {_FLAGS} FROM ({_scores('1', '(SELECT *, idx - 60 AS step FROM rec WHERE idx > 60)', _KEY)})) SELECT * FROM (SELECT run_id, count(*) AS nodes, count(*) FILTER (WHERE valid) AS valid_nodes, round(CAST(max(rank_score) AS DOUBLE), 9) AS best_score, arg_max(step, (rank_score, -step)) AS best_step, count(*) FILTER (WHERE loose_like) AS loose FROM fl GROUP BY run_id) JOIN (" + _HITS("step", (1, 5)) + ") USING (run_id)",
    "policy_unseen": _R + "SELECT candidate_id FROM (SELECT DISTINCT candidate_id, left(sha1(code), 16) AS h FROM candidate_programs WHERE code IS NOT NULL) WHERE h NOT IN (SELECT code_hash FROM rec WHERE code_hash IS NOT NULL)",
    "policy_bounds": _R + ", v AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY rank_score DESC, node_id) AS p FROM rec WHERE valid AND rank_score IS NOT NULL AND time_s IS NOT NULL), t AS (SELECT * FROM v WHERE p <= greatest(5, least(30, n))), "
        "f AS (SELECT run_id, string_agg(family, ',' ORDER BY i) AS families FROM (SELECT run_id, family, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, min(p)) AS i FROM t GROUP BY run_id, family) WHERE i <= 5 GROUP BY run_id) SELECT run_id, max(n) AS n, count(*) AS top_n, round(greatest(0.05, 4 * quantile_cont(time_s, 0.5)), 9) AS runtime_cap, families FROM t JOIN f USING (run_id) GROUP BY run_id, families",
    "policy_bound_items": _BOUND_ITEMS,
    "policy_family_summary": _R + "SELECT family, count(*) AS candidates, round(avg(valid::INT), 9) AS valid_rate, round(avg(cnbi - 100) FILTER (WHERE valid), 9) AS mean_delta, round(max(cnbi - 100) FILTER (WHERE valid), 9) AS top_delta, round(avg(time_s) FILTER (WHERE valid), 9) AS mean_time_s, round(max(rank_score) FILTER (WHERE valid), 9) AS top_rank_score, round(avg(coalesce(contains(error, 'timeout'), false)::INT), 9) AS slow_pattern_rate FROM rec GROUP BY family",
    "policy_experiment_summary": _M + ", a AS (SELECT *, row_number() OVER (PARTITION BY method_group ORDER BY valid DESC, coalesce(auc_cnbi, -1) DESC, dataset || '/' || method) AS p FROM m) SELECT method_group, count(*) AS candidates, round(avg(valid::INT), 9) AS valid_rate, round(avg((coalesce(time_s, 0) > 50)::INT), 9) AS slow_rate, round(avg(coalesce(contains(lower(error), 'timeout'), false)::INT), 9) AS timeout_rate, round(avg(auc_cnbi - 100) FILTER (WHERE valid), 9) AS mean_delta, round(max(auc_cnbi - 100) FILTER (WHERE valid), 9) AS best_delta, round(avg(auc_cnbi - 100) FILTER (WHERE valid AND p <= 5), 9) AS top5_delta, round(avg(time_s * 2), 9) AS mean_wall_s, round(avg(time_s * 2) FILTER (WHERE valid AND p <= 5), 9) AS top5_wall_s, count(*) FILTER (WHERE valid AND auc_cnbi IS NOT NULL AND r IS NOT NULL AND time_s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a y WHERE y.method_group = a.method_group AND y.valid AND y.auc_cnbi >= a.auc_cnbi AND y.r <= a.r AND y.time_s <= a.time_s AND (y.auc_cnbi > a.auc_cnbi OR y.r < a.r OR y.time_s < a.time_s))) AS pareto_count, round(avg(auc_cnbi) FILTER (WHERE valid), 9) AS mean_auc_cnbi, round(max(auc_cnbi) FILTER (WHERE valid), 9) AS best_auc_cnbi, round(avg(auc_cnbi) FILTER (WHERE valid AND p <= 5), 9) AS top5_auc_cnbi, round(avg(r) FILTER (WHERE valid), 9) AS mean_r, round(min(r) FILTER (WHERE valid), 9) AS best_r, round(avg(time_s) FILTER (WHERE valid), 9) AS mean_time_s, round(avg(time_s) FILTER (WHERE valid AND p <= 5), 9) AS top5_time_s, round(avg((source = 'rerun')::INT) FILTER (WHERE valid), 9) AS rerun_rate FROM a GROUP BY method_group",
    "policy_stage_progress": _R + "SELECT family, count(*) AS rows, count(*) FILTER (WHERE valid) AS valid_rows, count(*) FILTER (WHERE contains(lower(error), 'timeout')) AS timeouts, strftime(max(logged_at), '%Y-%m-%d %H:%M:%S') AS latest FROM rec GROUP BY family",
    "table_method_means": _M + ", " + _MEANS + "SELECT method, datasets, round(mean_r, 8) AS mean_r, round(mean_auc_cnbi, 8) AS mean_auc_cnbi, round(mean_time_s, 8) AS mean_time_s, top1_auc, top3_auc, round(CAST(mean_rank_auc AS DOUBLE), 8) AS mean_rank_auc FROM means",
}
