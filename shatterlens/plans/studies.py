"""Whole studies: validation of methods over graphs, and a search over typed score blends."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shatterlens.operators import adaptive, fragmentation as fr, policies as po, ranking as rk
from shatterlens.operators.windows import average_rank
from shatterlens.scratch import Scratch

_NUMBERS = ["r", "auc_acc", "auc_ncc", "auc_cnbi", "final_gcc", "final_ncc", "final_cnbi", "early_gcc", "early_ncc", "early_cnbi"]


def all_orders(edges: DataFrame, nodes: DataFrame, methods: dict, rate: float, known: DataFrame | None = None, limit_s: float | None = None) -> DataFrame:
    """(graph, method, step, node, seconds, error) of every pair of graph and method; pairs in ``known`` are not worked out again."""
    if known is None:
        return adaptive.adaptive_orders(edges, nodes, methods, rate, timed=True, limit_s=limit_s)
    have = known.select("graph", "method").distinct()
    out = known
    for name, kernel in methods.items():
        todo = nodes.select("graph").distinct().join(have.where(F.col("method") == name), "graph", "left_anti")
        some = lambda df: df.join(todo, "graph", "left_semi")  # noqa: B023, E731
        out = out.unionByName(adaptive.adaptive_orders(some(edges), some(nodes), {name: kernel}, rate, timed=True, limit_s=limit_s))
    return out


def per_graph(edges: DataFrame, nodes: DataFrame, orders: DataFrame, rate: float) -> DataFrame:
    """One row per (graph, method): metrics, time, validity, average ranks; a failed pair has no metrics."""
    pairs = orders.groupBy("graph", "method").agg(F.max("seconds").alias("time_s"), F.max("error").alias("error"), F.max("step").alias("n"))
    good = orders.where("step > 0").select("graph", "method", "step", "node")
    metrics = fr.summaries(fr.with_metrics(fr.trajectories(edges, nodes, good, rate)))
    rows = pairs.join(metrics, ["graph", "method"], "left").withColumn("valid", F.col("error").isNull())
    return rows.withColumns({"rank_r": average_rank(F.col("r"), ["graph"]), "rank_auc_cnbi": average_rank(F.col("auc_cnbi"), ["graph"], True)})


def validation(edges: DataFrame, nodes: DataFrame, methods: dict, rate: float, references: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per-graph table, method means, gate against references); orders are written once."""
    scratch = Scratch(edges.sparkSession)
    orders = scratch.save(all_orders(edges, nodes, methods, rate, known), "orders")
    table = scratch.save(per_graph(edges, nodes, orders, rate), "per_graph")
    means = po.rank_then_count(table, "graph", "method")
    return table, means, rk.gate(means, references)


def evaluated(edges: DataFrame, nodes: DataFrame, blends: dict[str, adaptive.Blend], rate: float) -> pd.DataFrame:
    """node_id, r, cnbi, time_s, valid of each blend: means over graphs of the residual variant; one job for all."""
    kernels = {k: (lambda g, steps, b=b: adaptive.blended(g, steps, b)) for k, b in blends.items()}
    orders = Scratch(edges.sparkSession).save(adaptive.adaptive_orders(edges, nodes, kernels, rate, timed=True), "orders")
    means = fr.plain_means(fr.with_metrics(fr.trajectories(edges, nodes, orders.where("step > 0").select("graph", "method", "step", "node"), rate), "residual"))
    seconds = orders.groupBy("method").agg(F.avg("seconds").alias("time_s"), F.max("error").isNull().alias("valid"))
    found = seconds.join(means.groupBy("method").agg(F.avg("r").alias("r"), F.avg("cnbi").alias("cnbi")), "method", "left")
    return found.withColumnRenamed("method", "node_id").toPandas()  # one row per blend


def search(edges: DataFrame, nodes: DataFrame, rounds: int, width: int = 4, rate: float = 0.30, seed: int = 0) -> pd.DataFrame:
    """Search over blends from the plain degree root: a round draws parents by squared score among the best, mutates and evaluates them.

    Only the few evaluated rows are on the driver; graphs, orders and curves stay tables. Times are
    measured but do not steer the search, so that a seed fixes its course.
    """
    rng = np.random.default_rng(seed)
    blends = {"root": adaptive.ROOT_BLEND, "reference": adaptive.REFERENCE_BLEND}
    parent_of = {"root": None, "reference": "root"}
    rows = evaluated(edges, nodes, blends, rate)
    for t in range(rounds):
        rows["score"] = 0.5 * rows["r"].rank(ascending=False, pct=True) + 0.5 * rows["cnbi"].rank(pct=True)
        pool = rows[rows["valid"]].sort_values(["score", "node_id"], ascending=[False, True]).head(8)
        chance = pool["score"] ** 2 / (pool["score"] ** 2).sum()
        fresh = {}
        seen = {str(asdict(b)) for b in blends.values()}
        middle, own = rows[rows["valid"]][["r", "cnbi"]].median(), rows.set_index("node_id")
        off = lambda parent, c, sign: float(np.clip(sign * (own.loc[parent, c] - middle[c]) / max(middle[c], 1e-9) + 0.45, 0.05, 0.95))  # noqa: B023, E731
        for i, parent in enumerate(rng.choice(pool["node_id"], size=width, p=chance)):
            needs = {"needs_scale": off(parent, "r", 1), "needs_fragmentation": off(parent, "cnbi", -1)}
            child = po.mutated(blends[parent], seed=int(rng.integers(1 << 31)), needs=needs)
            if str(asdict(child)) not in seen:
                fresh[f"n{t}_{i}"] = child
                parent_of[f"n{t}_{i}"] = parent
        blends |= fresh
        rows = pd.concat([rows, evaluated(edges, nodes, fresh, rate)], ignore_index=True)
    rows["score"] = 0.5 * rows["r"].rank(ascending=False, pct=True) + 0.5 * rows["cnbi"].rank(pct=True)
    return rows.assign(parent_id=rows["node_id"].map(parent_of))
