"""Whole-graph values in rounds: core numbers and communities of graphs of any size.

A graph of up to ``local_edges`` edges is one task of a grouped map; larger ones go through the same rounds as
joins over the written table, so that no task holds them. Both give the same rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shatterlens.operators.topology import adjacency, degrees
from shatterlens.scratch import Scratch

#: Greatest number of edges of a graph that one task takes.
LOCAL_EDGES = 2_000_000
#: Rounds after which label propagation gives up with an error.
MOST_ROUNDS = 500


def _core_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Core numbers by the same iteration: the h-index of the neighbours' values, from the degrees on."""
    names, flat = np.unique(pdf[["u", "v"]].to_numpy(), return_inverse=True)
    ends = flat.reshape(-1, 2)
    src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    value = np.bincount(src, minlength=len(names))
    start = np.concatenate([[0], np.cumsum(value)])
    while True:
        order = np.lexsort([-value[dst], src])
        place = np.arange(len(src)) - start[src[order]] + 1
        good = value[dst[order]] >= place
        new = np.bincount(src[order], weights=good, minlength=len(names)).astype(np.int64)
        if (new == value).all():
            return pd.DataFrame({"graph": pdf["graph"].iat[0], "node": names, "value": value})
        value = new


def _core_rounds(scratch: Scratch, edges: DataFrame) -> DataFrame:
    links = scratch.save(adjacency(edges), "links")
    value = scratch.save(degrees(edges).withColumnRenamed("degree", "value"), "value")
    while True:
        near = links.join(value.select("graph", F.col("node").alias("dst"), F.col("value").alias("near")), ["graph", "dst"])
        near = near.join(value.select("graph", F.col("node").alias("src"), "value"), ["graph", "src"])  # no neighbour counts for more than the node itself
        counts = near.groupBy("graph", "src", "value", F.least("near", "value").alias("h")).agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("graph", "src").orderBy(F.desc("h")))
        new = counts.withColumn("k", F.least("h", above)).groupBy("graph", F.col("src").alias("node"), F.col("value").alias("old")).agg(F.max("k").alias("value"))
        new = scratch.save(new, "value")
        scratch.drop(value)
        value = new.select("graph", "node", "value")
        if new.where("old <> value").isEmpty():
            return value


def _awake(node: int, turn: int) -> bool:
    return int(hashlib.md5(f"{node}|{turn}".encode()).hexdigest()[0], 16) % 2 == 0


def awake(node: Column, turn: int) -> Column:
    """Whether a node may move in a round: a bit of a hash, so that neighbours do not move in step for ever."""
    text = F.concat(node.cast("string"), F.lit(f"|{turn}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 1), 16, 10).cast("int") % 2 == 0


def propagate(near: dict[int, list[int]]) -> dict[int, int]:
    """Label of each node of a small graph; see ``communities``."""
    label = {i: i for i in near}
    for turn in range(MOST_ROUNDS):
        wish = {}
        for i, js in near.items():
            votes = Counter(label[j] for j in js)
            best = max(votes, key=lambda x: (votes[x], x), default=label[i])
            if votes[best] > votes[label[i]]:
                wish[i] = best
        if not wish:
            return label
        label.update({i: x for i, x in wish.items() if _awake(i, turn)})
    raise RuntimeError(f"labels still move after {MOST_ROUNDS} rounds")


def _community_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    near: dict[int, list[int]] = {}
    for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    label = propagate(near)
    return pd.DataFrame({"graph": pdf["graph"].iat[0], "node": list(label), "value": list(label.values())})


def _community_rounds(scratch: Scratch, edges: DataFrame) -> DataFrame:
    links = scratch.save(adjacency(edges), "links")
    label = scratch.save(degrees(edges).select("graph", "node", F.col("node").alias("value")), "label")
    for turn in range(MOST_ROUNDS):
        votes = links.join(label.select("graph", F.col("node").alias("dst"), F.col("value").alias("vote")), ["graph", "dst"]).groupBy("graph", F.col("src").alias("node"), "vote").agg(F.count(F.lit(1)).alias("n"))
        best = votes.join(label, ["graph", "node"]).groupBy("graph", "node", "value").agg(
            F.max(F.struct("n", "vote")).alias("best"), F.coalesce(F.max(F.when(F.col("vote") == F.col("value"), F.col("n"))), F.lit(0)).alias("own")
        )
        wish = scratch.save(best.select("graph", "node", "value", F.col("best.vote").alias("vote"), (F.col("best.n") > F.col("own")).alias("moves")), "wish")
        if wish.where("moves").isEmpty():
            return label
        new = scratch.save(wish.select("graph", "node", F.when(F.col("moves") & awake(F.col("node"), turn), F.col("vote")).otherwise(F.col("value")).alias("value")), "label")
        scratch.drop(label)
        scratch.drop(wish)
        label = new
    raise RuntimeError(f"labels still move after {MOST_ROUNDS} rounds")


def _by_size(edges: DataFrame, local_edges: int, kernel, rounds) -> DataFrame:
    schema = "graph string, node bigint, value bigint"
    scratch = Scratch(edges.sparkSession)
    big = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > local_edges).select("graph")
    big = scratch.save(big, "big")  # at most edges / local_edges of them
    if big.isEmpty():
        return edges.groupBy("graph").applyInPandas(kernel, schema)
    small = edges.join(F.broadcast(big), "graph", "left_anti").groupBy("graph").applyInPandas(kernel, schema)
    return small.unionByName(rounds(scratch, edges.join(F.broadcast(big), "graph", "left_semi")))


def core_numbers(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(graph, node, value): core number of every node with an edge."""
    return _by_size(edges, local_edges, _core_kernel, _core_rounds)


def communities(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(graph, node, value): communities by label propagation, named by one of their nodes.

    Every node starts with its own label. In each round a node wishes for its neighbours' most frequent label, of
    equal ones the largest, if that is more frequent than its own; the awake half of those who wish moves. It
    ends when nobody wishes; after MOST_ROUNDS rounds RuntimeError.
    """
    return _by_size(edges, local_edges, _community_kernel, _community_rounds)
