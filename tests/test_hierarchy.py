import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from shatterlens.operators.hierarchy import hierarchy, hierarchy_below, hierarchy_paths, solve_forest

SCHEMA = "run_id string, node_id string, parent_id string, ingested_at timestamp, depth string"
T0 = datetime(2024, 1, 1)


def brute(parent: dict) -> dict:
    """key -> (root, depth, descendants, state, path) by walking."""
    out = {}
    kids: dict = {}
    for k, p in parent.items():
        if p is not None:
            kids.setdefault(p, []).append(k)
    for k in parent:
        seen, path, at = {k}, [k], parent[k]
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent[at]
        below, todo = set(), list(kids.get(k, []))
        while todo:
            x = todo.pop()
            if x not in below:
                below.add(x)
                todo += kids.get(x, [])
        on_loop = k in below
        state = "cycle" if on_loop else "tree" if at is None else "below_cycle"
        tree = state == "tree"
        out[k] = (path[-1][1] if tree else "", len(path) - 1 if tree else -1, len(below - {k}), state, "/".join(x[1] for x in reversed(path)) if tree else None)
    return out


def below_of(parent: dict, k: tuple) -> set:
    """Ids of all others that lead to ``k``."""
    out = set()
    for u in parent:
        seen, at = set(), parent[u]
        while at is not None and at not in seen:
            seen.add(at)
            at = parent[at]
        if k in seen and u != k:
            out.add(u[1])
    return out


def make(seed: int, runs: int, most: int):
    rng = random.Random(seed)
    rows, parent = [], {}
    for r in range(runs):
        names = [f"n{i}" for i in range(rng.randint(1, most))]
        for i, v in enumerate(names):
            kind = rng.random()
            p = None if kind < 0.1 else "gone" if kind < 0.15 else rng.choice(names) if kind < 0.25 else names[max(0, i - 1)] if kind < 0.5 else rng.choice(names[: i + 1])
            rows.append((f"r{r}", v, p, T0, "clash"))
            parent[f"r{r}", v] = (f"r{r}", p) if p in names else None
    return rows, parent


@pytest.mark.parametrize("local_rows", [10_000, 4])
def test_both_ways_equal_walking(spark, local_rows):
    rows, parent = make(3, 5, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.run_id, r.node_id): (r.root_id, r.depth, r.n_descendants, r.state) for r in hierarchy(df, local_rows, 20).collect()}
    paths = {(r.run_id, r.node_id): r.path for r in hierarchy_paths(df, "/", local_rows, 20).collect()}
    want = brute(parent)
    pairs = sorted((r.run_id, r.node_id, r.below_id) for r in hierarchy_below(df, local_rows, 20).collect())
    assert pairs == sorted((k[0], k[1], u) for k in parent for u in below_of(parent, k))
    assert got == {k: v[:4] for k, v in want.items()}
    assert paths == {k: v[4] for k, v in want.items() if v[4] is not None}


@pytest.mark.parametrize("local_rows", [10_000, 2])
def test_intervals_hold_the_descendants(spark, local_rows):
    rows = [("r", "a", None, T0, ""), ("r", "b", "a", T0, ""), ("r", "c", "a", T0, ""), ("r", "d", "b", T0, "")]
    at = {r.node_id: r for r in hierarchy(spark.createDataFrame(rows, SCHEMA), local_rows).collect()}
    inside = lambda v: {u for u, r in at.items() if at[v].pre < r.pre <= at[v].pre + at[v].n_descendants}
    assert inside("a") == {"b", "c", "d"} and inside("b") == {"d"} and inside("c") == inside("d") == set()


@pytest.mark.parametrize("local_rows", [10_000, 1])
def test_nulls_repeats_and_newest_row(spark, local_rows):
    later = T0 + timedelta(hours=1)
    rows = [
        ("r", "a", None, T0, ""), ("r", "a", None, T0, ""), ("r", "b", "a", T0, ""), ("r", "b", "missing", later, ""),
        (None, "a", None, T0, ""), (None, "c", "a", T0, ""), ("r", None, "a", T0, ""), ("r", "s", "s", None, ""), ("r", "", " ", T0, ""),
    ]
    got = {(r.run_id, r.node_id): (r.root_id, r.depth, r.n_descendants, r.state) for r in hierarchy(spark.createDataFrame(rows, SCHEMA), local_rows).collect()}
    assert got == {
        ("r", "a"): ("a", 0, 1, "tree"), ("r", "b"): ("b", 0, 0, "tree"), (None, "a"): ("a", 0, 1, "tree"), (None, "c"): ("a", 1, 0, "tree"),
        ("r", None): ("a", 1, 0, "tree"), ("r", "s"): ("", -1, 0, "cycle"), ("r", ""): ("", 0, 0, "tree"),
    }


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hierarchy_below(df).count() == 0 and hierarchy(df).count() == 0 and hierarchy_paths(df).count() == 0


def test_kernel_on_a_long_chain():
    n = 50_000
    x = solve_forest(np.arange(-1, n - 1))
    assert (x["depth"] == np.arange(n)).all() and (x["below"] == np.arange(n)[::-1]).all() and (x["pre"] == np.arange(n)).all()


def test_a_run_beyond_one_task(spark):
    """The rounds of joins at the production limit: 100,200 records of one run, a loop of 60 with trees below it included."""
    rng = np.random.default_rng(4)
    n = 100_200
    parent = (np.arange(n) * rng.random(n) ** 0.3).astype(np.int64)
    parent[:2] = -1
    parent[500:559], parent[559] = np.arange(501, 560), 500
    ids = [f"n{i}" for i in range(n)]
    import pandas as pd

    rows = pd.DataFrame({"run_id": "r", "node_id": ids, "parent_id": [None if p < 0 else ids[p] for p in parent], "ingested_at": T0})
    df = spark.createDataFrame(rows, "run_id string, node_id string, parent_id string, ingested_at timestamp")
    got = hierarchy(df).toPandas().set_index("node_id").loc[ids]
    x = solve_forest(parent)
    tree = x["state"] == 0
    assert (got["n_descendants"].to_numpy() == x["below"]).all() and (got["depth"].to_numpy() == np.where(tree, x["depth"], -1)).all()
    assert (got["root_id"].to_numpy() == np.where(tree, np.array(ids)[x["root"]], "")).all() and (got["state"] == "cycle").sum() == 60
