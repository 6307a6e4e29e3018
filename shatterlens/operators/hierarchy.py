"""Parent-child rows to full hierarchies: path, depth, root, descendants, loops.

Leaves are peeled to expose the loops, loops are cut, an Euler tour (one arc into and one out of
every record) is laid through each tree, and parallel list ranking gives every arc its place.
Entry and exit then answer everything: depth is the number of open records at the entry,
descendants lie between entry and exit, ``pre`` is the place among the entries.

Trees never leave their run. Runs of at most ``local_rows`` records are packed into bundles of a
few runs and each bundle is worked off by one NumPy kernel after a single shuffle. Longer runs go
through the same steps as DataFrame rounds, so no task ever holds an unbounded run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from shatterlens.operators.records import current_rows
from shatterlens.operators.skew import lookup_join
from shatterlens.scratch import Scratch

#: Greatest number of rows of a run that one task takes.
LOCAL_ROWS = 100_000
#: Rows aimed at for a bundle of runs.
BUNDLE_ROWS = 25_000
#: Pairs made at a time, and entries of a block of the tour that intervals are joined with.
PAIRS, BLOCK_ENTRIES = 1 << 18, 4096
#: A peeling round must take at least this share of the records, else doubling takes over.
PEEL_SHARE = 1 / 8
TREE, CYCLE, BELOW = "tree", "cycle", "below_cycle"

_SCHEMA = "run_id string, node_id string, root_id string, depth int, n_descendants bigint, state string, pre bigint"


def loops(parent: np.ndarray) -> np.ndarray:
    """Which nodes lie on a loop: those that peeling of leaves never reaches."""
    n = len(parent)
    waiting = np.bincount(parent[parent >= 0], minlength=n)
    left = np.ones(n, dtype=bool)
    leaves = np.flatnonzero(waiting == 0)
    while len(leaves):
        left[leaves] = False
        up = parent[leaves]
        above, k = np.unique(up[up >= 0], return_counts=True)
        waiting[above] -= k
        leaves = above[waiting[above] == 0]
    return left


def euler_succ(parent: np.ndarray) -> np.ndarray:
    """Next arc of each arc of a forest: arc v enters node v, arc n + v leaves it; the last arc of a tree follows itself."""
    n = len(parent)
    child = np.flatnonzero(parent >= 0)
    child = child[np.argsort(parent[child], kind="stable")]
    above = parent[child]
    succ = np.empty(2 * n, dtype=np.int64)
    succ[:n] = np.arange(n) + n
    first = np.ones(len(child), dtype=bool)
    first[1:] = above[1:] != above[:-1]
    succ[above[first]] = child[first]
    succ[n:] = np.arange(n) + n
    succ[n + child] = n + above
    follows = np.flatnonzero(~first)
    succ[n + child[follows - 1]] = child[follows]
    return succ


def rank_list(succ: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pointer jumping: steps to the list's last arc, weights up to before it, and that arc."""
    at = np.arange(len(succ))
    steps = (succ != at).astype(np.int64)
    total = np.where(succ != at, weight, 0)
    while True:
        beyond = succ[succ]
        if np.array_equal(beyond, succ):
            return steps, total, succ
        steps = steps + steps[succ]
        total = total + total[succ]
        succ = beyond


def solve_forest(parent: np.ndarray) -> dict[str, np.ndarray]:
    """root, depth, descendants, state (0 tree, 1 loop, 2 below one), pre of each node, descendants with loops cut, least node of its loop; parent -1 for none."""
    n = len(parent)
    on_loop = loops(parent)
    cut = np.where(on_loop, -1, parent)
    succ = euler_succ(cut)
    weight = np.repeat(np.array([1, -1]), n)
    steps, total, last = rank_list(succ, weight)
    root = last[:n] - n
    depth = 1 - total[:n]  # the last arc's own -1 is not in total
    below = (steps[:n] - steps[n:] - 1) // 2
    entry = steps[root] - steps[:n]  # arcs before the entry: entries less exits are the depth
    state = np.where(on_loop, 1, np.where(on_loop[root], 2, 0))
    own, low = below, np.arange(n)
    if on_loop.any():
        ring = np.flatnonzero(on_loop)
        hop = np.where(on_loop, parent, np.arange(n))
        for _ in range(max(1, math.ceil(math.log2(len(ring) + 1)))):
            low = np.minimum(low, low[hop])
            hop = hop[hop]
        mass = np.bincount(low[ring], weights=below[ring] + 1, minlength=n).astype(np.int64)
        below = below.copy()
        below[ring] = mass[low[ring]] - 1
    return {"root": root, "depth": depth, "below": below, "state": state, "pre": (entry + depth) // 2, "own": own, "low": low}


def _parents(run: np.ndarray, node: pd.Series, parent: pd.Series) -> np.ndarray:
    """Index of each row's parent row in the same run, or -1."""
    n = len(node)
    code, _ = pd.factorize(pd.concat([node, parent], ignore_index=True), use_na_sentinel=True)
    width = int(code.max(initial=0)) + 2
    own, up = run * width + code[:n] + 1, run * width + code[n:] + 1
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(own[order], up)
    hit = (at < n) & (code[n:] >= 0)
    hit[hit] = own[order][at[hit]] == up[hit]
    out = np.full(n, -1, dtype=np.int64)
    out[hit] = order[at[hit]]
    return out


def _bundle(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, dict[str, np.ndarray]]:
    pdf = pdf.sort_values(["run_id", "node_id"], ignore_index=True, na_position="first")
    run, _ = pd.factorize(pdf["run_id"], use_na_sentinel=False)
    parent = _parents(run.astype(np.int64), pdf["node_id"], pdf["parent_id"])
    return pdf, parent, solve_forest(parent)


def _solve_bundle(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, _, x = _bundle(pdf)
    tree = x["state"] == 0
    return pd.DataFrame({
        "run_id": pdf["run_id"], "node_id": pdf["node_id"],
        "root_id": np.where(tree, pdf["node_id"].to_numpy()[x["root"]], ""),
        "depth": np.where(tree, x["depth"], -1).astype(np.int32),
        "n_descendants": x["below"], "state": np.array([TREE, CYCLE, BELOW], dtype=object)[x["state"]],
        "pre": np.where(tree, x["pre"], -1),
    })


def _tour_order(x: dict[str, np.ndarray]) -> np.ndarray:
    """Nodes in the order of their entries, tree after tree."""
    return np.lexsort([x["pre"], x["root"]])


def _bundle_paths(separator: str):
    def paths(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, x = _bundle(pdf)
        order = _tour_order(x)
        order = order[x["state"][order] == 0]
        node, depth = pdf["node_id"].fillna("").to_numpy(), x["depth"]
        open_: list[str] = []  # paths of the entries that are open
        path = []
        for i in order:
            del open_[depth[i] :]
            open_.append(open_[-1] + separator + node[i] if open_ else node[i])
            path.append(open_[-1])
        return pdf[["run_id", "node_id"]].iloc[order].assign(path=np.array(path, dtype=object))

    return paths


def _bundle_below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a bundle, in blocks: what is between entry and exit of a record follows it in the tour."""
    pdf, _, x = _bundle(pd.concat(list(batches), ignore_index=True))
    order, own = _tour_order(x), x["own"]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    run, node = pdf["run_id"].to_numpy(), pdf["node_id"].to_numpy()
    rows = lambda v, u: pd.DataFrame({"run_id": run[v], "node_id": node[v], "below_id": node[u]})
    upto = np.cumsum(own)
    at = 0
    while at < len(own):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        n = own[at:end]
        v = np.repeat(np.arange(at, end), n)
        yield rows(v, order[place[v] + 1 + np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)])
        at = end
    ring = np.flatnonzero(x["state"] == 1)
    for members in np.split(ring[np.argsort(x["low"][ring], kind="stable")], np.flatnonzero(np.diff(np.sort(x["low"][ring]))) + 1):
        trees = [order[place[r] : place[r] + own[r] + 1] for r in members]
        for k, v in enumerate(members):
            others = trees[:k] + trees[k + 1 :]
            if others:
                u = np.concatenate(others)
                yield rows(np.full(len(u), v), u)


def _doubling(scratch: Scratch, t: DataFrame, sums: list[str], label: str) -> DataFrame:
    """List ranking by pointer jumping over t(arc, succ, last, sums...): succ NULL at a list's end.

    After round k every arc knows its next 2^k arcs; the rounds end when none is open, or once
    2^k exceeds the number of arcs (what is then still open runs in a circle).
    """
    t = scratch.save(t, label)
    most, k = max(t.count(), 1), 0
    while 1 << k <= most:
        if t.where(F.col("succ").isNotNull()).isEmpty():
            break
        far = t.select(F.col("arc").alias("succ"), F.col("succ").alias("_s"), F.col("last").alias("_l"), *[F.col(s).alias(f"_{s}") for s in sums])
        jumped = t.where(F.col("succ").isNotNull()).join(far, "succ").select("arc", F.col("_s").alias("succ"), F.col("_l").alias("last"), *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in sums])
        new = scratch.save(t.where(F.col("succ").isNull()).unionByName(jumped), label)
        scratch.drop(t)
        t, k = new, k + 1
    return t


def _loops_of(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """Loop members (id, parent) of nodes(id, parent): peel leaves while that shrinks the rest fast, then keep what 2^k jumps still reach."""
    rest = nodes.where(F.col("parent").isNotNull()).select("id", "parent")
    rest = scratch.save(rest, "peel")
    n = rest.count()
    while n:
        inner = rest.join(rest.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
        new = scratch.save(inner.join(inner.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent"), "peel")
        left = new.count()
        scratch.drop(rest)
        rest = new
        slow, n = left > n * (1 - PEEL_SHARE), left
        if slow:
            break
    if not n:
        return rest
    hop, k = rest.select("id", F.col("parent").alias("hop")), 0
    while 1 << k <= n:
        hop = scratch.save(hop.join(hop.select(F.col("id").alias("hop"), F.col("hop").alias("_h")), "hop").select("id", F.col("_h").alias("hop")), "hop")
        k += 1
        if hop.isEmpty():
            break
    return rest.join(hop.select(F.col("hop").alias("id")).distinct(), "id", "left_semi")


def _numbered(scratch: Scratch, records: DataFrame) -> DataFrame:
    """nodes(id, run_id, node_id, parent): ids are fixed by writing them, parents are ids."""
    rows = scratch.save(records.withColumn("id", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    key = [F.coalesce(F.concat(F.lit("="), "run_id"), F.lit("")).alias("_run")]  # NULL is a run like others
    side = rows.where(F.col("node_id").isNotNull()).select(*key, F.col("node_id").alias("_up"), F.col("id").alias("parent"))
    return scratch.save(lookup_join(rows.select("id", "run_id", "node_id", *key, F.col("parent_id").alias("_up")), side, ["_run", "_up"], total).select("id", "run_id", "node_id", "parent"), "nodes")


def _tour(nodes: DataFrame) -> DataFrame:
    """Arcs of nodes(id, parent): (arc, succ, last, w, steps). Arc 2 id enters, 2 id + 1 leaves.

    Siblings are ordered by id and chained within blocks of ids first, then block to block, so
    that a parent of very many children never has them in one task.
    """
    kids = nodes.where(F.col("parent").isNotNull()).select("id", "parent", F.shiftright("id", 16).alias("block"))
    kids = kids.withColumn("next", F.lead("id").over(Window.partitionBy("parent", "block").orderBy("id")))
    blocks = kids.groupBy("parent", "block").agg(F.min("id").alias("head"))
    chain = blocks.withColumn("after", F.lead("head").over(Window.partitionBy("parent").orderBy("block")))
    ends = kids.where(F.col("next").isNull()).drop("next").join(chain.select("parent", "block", F.col("after").alias("next")), ["parent", "block"])
    after = kids.where(F.col("next").isNotNull()).unionByName(ends).select("id", "next")
    heads = blocks.groupBy(F.col("parent").alias("id")).agg(F.min("head").alias("first"))
    x = nodes.select("id", "parent").join(heads, "id", "left").join(after, "id", "left")
    enter = x.select((F.col("id") * 2).alias("arc"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("succ"), F.lit(1).cast("long").alias("w"), "id")
    leave = x.select((F.col("id") * 2 + 1).alias("arc"), F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("succ"), F.lit(-1).cast("long").alias("w"), "id")
    arcs = enter.unionByName(leave)
    open_ = F.col("succ").isNotNull()
    return arcs.select("arc", "succ", F.when(~open_, F.col("id")).alias("last"), F.when(open_, F.col("w")).otherwise(0).alias("w"), F.when(open_, F.lit(1)).otherwise(0).cast("long").alias("steps"))


def _solve_large(scratch: Scratch, records: DataFrame, cut_loops: bool = False) -> DataFrame:
    """The columns of ``hierarchy``; with ``cut_loops`` id, run_id, node_id, root, pre and below of the forest that cutting loops leaves, and ring, the parent on a loop."""
    nodes = _numbered(scratch, records)
    ring = scratch.save(_loops_of(scratch, nodes), "ring")
    cut = nodes.join(ring.select("id", F.lit(True).alias("on_loop")), "id", "left").withColumn("on_loop", F.coalesce("on_loop", F.lit(False)))
    cut = scratch.save(cut.withColumn("parent", F.when(~F.col("on_loop"), F.col("parent"))), "cut")
    arcs = _doubling(scratch, _tour(cut), ["w", "steps"], "arcs")
    side = lambda bit, names: arcs.where(F.col("arc") % 2 == bit).select(F.shiftright("arc", 1).alias("id"), *[F.col(a).alias(b) for a, b in names.items()])
    x = cut.join(side(0, {"w": "w", "steps": "s0", "last": "root"}), "id").join(side(1, {"steps": "s1"}), "id")
    tops = cut.where(F.col("parent").isNull()).select(F.col("id").alias("root"), F.col("node_id").alias("root_id"), F.col("on_loop").alias("under"))
    tops = tops.join(side(0, {"steps": "s_root"}).withColumnRenamed("id", "root"), "root")
    x = lookup_join(x, tops, ["root"], cut.count())
    x = scratch.save(x.select("id", "run_id", "node_id", "root", "root_id", "on_loop", "under", (1 - F.col("w")).alias("depth"), F.expr("(s0 - s1 - 1) div 2").alias("below"), F.expr("(s_root - s0 + 1 - w) div 2").alias("pre")), "solved")
    if cut_loops:
        return x.join(ring.select("id", F.col("parent").alias("ring")), "id", "left").select("id", "run_id", "node_id", "root", "pre", "below", "ring")
    state = F.when(F.col("on_loop"), CYCLE).when(F.col("under"), BELOW).otherwise(TREE)
    if not ring.isEmpty():
        low = ring.select("id", F.col("parent").alias("hop"), F.col("id").alias("low"))
        n, k = ring.count(), 0
        while 1 << k <= n:  # least id of each loop by doubling
            far = low.select(F.col("id").alias("hop"), F.col("hop").alias("_h"), F.col("low").alias("_l"))
            low = scratch.save(low.join(far, "hop").select("id", F.col("_h").alias("hop"), F.least("low", "_l").alias("low")), "low")
            k += 1
        mass = low.join(x.select("id", "below"), "id").groupBy("low").agg((F.sum(F.col("below") + 1) - 1).alias("_mass"))
        x = x.join(low.join(mass, "low").select("id", "_mass"), "id", "left").withColumn("below", F.coalesce("_mass", "below"))
    x = x.withColumn("state", state)
    tree = F.col("state") == TREE
    return x.select(
        "run_id", "node_id", F.when(tree, F.col("root_id")).otherwise("").alias("root_id"), F.when(tree, F.col("depth")).otherwise(-1).cast("int").alias("depth"),
        F.col("below").alias("n_descendants"), "state", F.when(tree, F.col("pre")).otherwise(-1).cast("long").alias("pre"),
    )


def _large_below(scratch: Scratch, records: DataFrame) -> DataFrame:
    """The same pairs by a join of intervals with entries, block by block, so that no task holds a tree."""
    x = scratch.save(_solve_large(scratch, records, cut_loops=True), "forest")
    block = lambda c: F.floor(c / BLOCK_ENTRIES)
    over = x.where("below > 0").select("id", "run_id", "node_id", "root", "pre", "below", F.explode(F.sequence(block(F.col("pre") + 1), block(F.col("pre") + F.col("below")))).alias("block"))
    under = x.select("root", block(F.col("pre")).alias("block"), F.col("pre").alias("at"), F.col("node_id").alias("below_id"))
    inside = (F.col("at") > F.col("pre")) & (F.col("at") <= F.col("pre") + F.col("below"))
    own = over.join(under, ["root", "block"]).where(inside).select("id", "run_id", "node_id", "below_id")
    ring = x.where(F.col("ring").isNotNull())
    if ring.isEmpty():
        return own.drop("id")
    low = scratch.save(ring.select("id", F.col("ring").alias("hop"), F.col("id").alias("low")), "low")
    n, k = low.count(), 0
    while 1 << k <= n:
        far = low.select(F.col("id").alias("hop"), F.col("hop").alias("_h"), F.col("low").alias("_l"))
        low = scratch.save(low.join(far, "hop").select("id", F.col("_h").alias("hop"), F.least("low", "_l").alias("low")), "low")
        k += 1
    mates = low.select("low", F.col("id").alias("v")).join(low.select("low", "id"), "low").where(F.col("v") != F.col("id")).select("v", "id")
    whole = own.select("id", "below_id").unionByName(ring.select("id", F.col("node_id").alias("below_id")))
    theirs = mates.join(whole, "id").drop("id").withColumnRenamed("v", "id").join(ring.select("id", "run_id", "node_id"), "id")
    return own.drop("id").unionByName(theirs.select("run_id", "node_id", "below_id"))


def _large_paths(scratch: Scratch, records: DataFrame, separator: str) -> DataFrame:
    nodes = _numbered(scratch, records)
    t = nodes.select("id", "run_id", "node_id", F.col("parent").alias("hop"), F.coalesce("node_id", F.lit("")).alias("path"))
    t = scratch.save(t, "path")
    n, k = t.count(), 0
    while 1 << k <= n and not t.where(F.col("hop").isNotNull()).isEmpty():
        far = t.select(F.col("id").alias("hop"), F.col("hop").alias("_h"), F.col("path").alias("_p"))
        new = scratch.save(lookup_join(t, far, ["hop"], n).select("id", "run_id", "node_id", F.col("_h").alias("hop"), F.when(F.col("hop").isNull(), F.col("path")).otherwise(F.concat_ws(separator, "_p", "path")).alias("path")), "path")
        scratch.drop(t)
        t, k = new, k + 1
    return t.where(F.col("hop").isNull()).select("run_id", "node_id", "path")


def _by_size(records: DataFrame, local_rows: int, bundle_rows: int, kernel, schema: str, distributed) -> DataFrame:
    scratch = Scratch(records.sparkSession)
    sizes = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    big = scratch.save(sizes.where(F.col("n") > local_rows).select("run_id", F.lit(True).alias("_big")), "big")  # at most rows / local_rows of them
    has_big = not big.isEmpty()
    small = records
    if has_big:
        same = records["run_id"].eqNullSafe(big["run_id"])
        small = records.join(F.broadcast(big), same, "left_anti")
    bundles = max(1, records.count() // bundle_rows)
    small = small.withColumn("_bundle", F.pmod(F.xxhash64("run_id"), F.lit(bundles)))
    keys = ["_bundle", "run_id", "node_id"]
    one = current_rows(small.repartition("_bundle"), keys, "ingested_at", ["parent_id"])
    out = one.groupBy("_bundle").applyInPandas(kernel, schema)
    if has_big:
        large = records.join(F.broadcast(big), same, "left_semi")
        out = out.unionByName(distributed(scratch, current_rows(large, ["run_id", "node_id"], "ingested_at", ["parent_id"])))
    return out


def hierarchy(records: DataFrame, local_rows: int = LOCAL_ROWS, bundle_rows: int = BUNDLE_ROWS) -> DataFrame:
    """(run_id, node_id, root_id, depth, n_descendants, state, pre), one row per record.

    ``records`` has run_id, node_id, parent_id, ingested_at; of repeated deliveries the newest
    names the parent. The parent is the record of that node_id in the same run (letter for letter);
    NULL, dangling or damaged parents make a record a root. NULL run ids form one run, a record
    with a NULL node_id can be no one's parent. state is ``cycle`` on a loop (own parent
    included), ``below_cycle`` under one, else ``tree``; off a tree root_id is '' and depth and pre
    are -1. The records below v are those of its tree with pre in (v.pre, v.pre + n_descendants].
    An empty table gives no rows.
    """
    rows = records.select("run_id", "node_id", "parent_id", "ingested_at")
    return _by_size(rows, local_rows, bundle_rows, _solve_bundle, _SCHEMA, _solve_large)


def hierarchy_paths(records: DataFrame, separator: str = "/", local_rows: int = LOCAL_ROWS, bundle_rows: int = BUNDLE_ROWS) -> DataFrame:
    """(run_id, node_id, path) of the records on trees, root first; NULL ids are written as ''."""
    rows = records.select("run_id", "node_id", "parent_id", "ingested_at")
    return _by_size(rows, local_rows, bundle_rows, _bundle_paths(separator), "run_id string, node_id string, path string", lambda s, r: _large_paths(s, r, separator))


def hierarchy_below(records: DataFrame, local_rows: int = LOCAL_ROWS, bundle_rows: int = BUNDLE_ROWS) -> DataFrame:
    """(run_id, node_id, below_id): every record with each record below it, by entry-exit intervals.

    On a loop that includes the loop's other members and what is below them. As many rows as the sum of ``n_descendants``,
    which is the sum of the depths where there are no loops; they are made in blocks.
    """
    rows = records.select("run_id", "node_id", "parent_id", "ingested_at")
    return _by_size(rows, local_rows, bundle_rows, _bundle_below, "run_id string, node_id string, below_id string", _large_below)
