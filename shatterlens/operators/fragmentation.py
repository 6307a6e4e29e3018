"""How removals fragment a graph: states, trajectories, summaries.

With n nodes at first, k removed and component sizes s: gcc = max s / n, ncc their number, top5 the
mass of the five largest / n, hhi = sum s^2 / (n - k)^2, ec = 1 / hhi, pd = 1 - sum s (s - 1) / (n (n - 1)),
cnbi = pd * ec / (1 + top5). VARIANTS differ in what pd and top5 are divided by.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shatterlens.operators.static_orders import budget

#: original: pd and top5 over the first n; residual: over what is left; paper: pd over what is left, top5 over n.
VARIANTS = ("original", "residual", "paper")
STATES = "graph string, method string, step int, removal_ratio double, n bigint, left bigint, largest bigint, ncc bigint, top5 bigint, squares bigint"


def positioned(edges: DataFrame, orders: DataFrame) -> DataFrame:
    """(graph, method, hi, lo): edges as the places of their ends in each order, the earlier one as lo."""
    at = lambda c, p: orders.select("graph", "method", F.col("node").alias(c), F.col("step").alias(p))
    both = edges.join(at("u", "pu"), ["graph", "u"]).join(at("v", "pv"), ["graph", "method", "v"])
    return both.select("graph", "method", F.greatest("pu", "pv").alias("hi"), F.least("pu", "pv").alias("lo"))


def _states(n: int, most: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(largest, ncc, top5, squares) after k = 1..most removals, worked out backwards: nodes come back and join."""
    order = np.argsort(-lo, kind="stable")
    lo, hi = lo[order].tolist(), hi[order].tolist()
    above = list(range(n + 1))
    size = [1] * (n + 1)
    sizes, count = ([1], {1: n - most}) if n > most else ([], {})  # of the components: different ones, ascending, and how many have each
    squares, parts, at, out = n - most, n - most, 0, []

    def less(x: int) -> None:
        if count[x] > 1:
            count[x] -= 1
        else:
            del count[x], sizes[bisect_left(sizes, x)]

    def more(x: int) -> None:
        if x in count:
            count[x] += 1
        else:
            count[x] = 1
            insort(sizes, x)

    def five() -> int:
        total, wanted = 0, 5
        for x in reversed(sizes):
            total += x * min(wanted, count[x])
            if (wanted := wanted - count[x]) <= 0:
                break
        return total

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for k in range(most, 0, -1):
        while at < len(lo) and lo[at] > k:  # both ends are left after k removals
            a, b = top(lo[at]), top(hi[at])
            at += 1
            if a != b:
                if size[a] < size[b]:
                    a, b = b, a
                x, y = size[a], size[b]
                less(x)
                less(y)
                more(x + y)
                parts -= 1
                squares += 2 * x * y
                above[b] = a
                size[a] = x + y
        out.append((k, sizes[-1] if sizes else 0, parts, five(), squares))
        more(1)
        parts += 1
        squares += 1
    return out[::-1]


def state_rows(graph: str, method: str, n: int, most: int, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """STATES of one order, of the places of its edges' ends."""
    k, largest, ncc, top5, squares = (np.array(x, dtype=np.int64) for x in zip(*_states(n, most, lo, hi)))
    return pd.DataFrame({"graph": graph, "method": method, "step": k.astype(np.int32), "removal_ratio": k / n, "n": n, "left": n - k, "largest": largest, "ncc": ncc, "top5": top5, "squares": squares})


def spanning_forest(places: DataFrame, fan_in: int = 8) -> DataFrame:
    """Edges of places(graph, method, hi, lo) that a trajectory needs: a spanning forest of greatest lo.

    Components after k removals are those of the edges with lo > k, for all k at once those of a
    maximum spanning forest. Each partition keeps the forest of its own edges, and partitions are
    merged ``fan_in`` at a time, so that at most (n - 1) edges a graph and order ever leave a task.
    """

    def local(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        kept = []
        for _, g in pdf.groupby(["graph", "method"], sort=False):
            g = g.sort_values("lo", ascending=False)
            above: dict[int, int] = {}

            def top(i: int, above: dict[int, int] = above) -> int:
                while above.setdefault(i, i) != i:
                    above[i] = above[above[i]]
                    i = above[i]
                return i

            keep = []
            for a, b in zip(g["lo"].tolist(), g["hi"].tolist()):
                a, b = top(a), top(b)
                keep.append(a != b)
                above[b] = a
            kept.append(g[keep])
        yield pd.concat(kept)

    schema = places.schema
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = places.mapInPandas(local, schema).coalesce(n).mapInPandas(local, schema)
    while n > 1:
        n = -(-n // fan_in)
        out = out.coalesce(n).mapInPandas(local, schema)
    return out


def trajectories(edges: DataFrame, nodes: DataFrame, orders: DataFrame, rate: Column | float) -> DataFrame:
    """STATES after each removal up to the budget of ``rate``; one task per (graph, method), on integers only.

    Orders are permutations of the graph's nodes, as complete_order and the order operators make.
    """
    sizes = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("most", budget(F.col("n"), rate))
    places = positioned(edges, orders)
    heads = orders.select("graph", "method").distinct().select("graph", "method", F.lit(None).cast("int").alias("hi"), F.lit(None).cast("int").alias("lo"))
    rows = places.unionByName(heads).join(sizes, "graph")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        n, most = int(pdf["n"].iat[0]), int(pdf["most"].iat[0])
        real = pdf[pdf["lo"].notna()]
        return state_rows(pdf["graph"].iat[0], pdf["method"].iat[0], n, most, real["lo"].to_numpy(np.int64), real["hi"].to_numpy(np.int64))

    # A number of partitions that is asked for stays: small tasks would be joined to one that works off all orders in turn.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "graph", "method").groupBy("graph", "method").applyInPandas(kernel, STATES)


def states_by_components(sizes: DataFrame) -> DataFrame:
    """STATES without ratio from component sizes(graph, method, step, n, size), all by aggregation."""
    keys = ["graph", "method", "step", "n"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size")))
    ranked = sizes.withColumn("_r", rank)
    return ranked.groupBy(*keys).agg(
        F.sum("size").alias("left"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("ncc"),
        F.sum(F.when(F.col("_r") <= 5, F.col("size"))).alias("top5"), F.sum(F.col("size") * F.col("size")).alias("squares"),
    )


def with_metrics(states: DataFrame, variant: str = "original") -> DataFrame:
    """States with gcc, top5_mass, hhi, ec, pd, cnbi; integers until one division each."""
    n, left, squares = F.col("n").cast("double"), F.col("left").cast("double"), F.col("squares").cast("double")
    hhi = squares / F.pow(F.greatest(F.lit(1.0), left), F.lit(2.0))
    ec = F.when(hhi > 0, 1 / hhi).otherwise(0.0)
    all_pairs, left_pairs = F.greatest(F.lit(1.0), n * (n - 1)), F.greatest(F.lit(1.0), left * (left - 1))
    linked = F.col("squares") - F.col("left")
    over_left = F.when(left <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - linked / left_pairs))
    pairs = {"original": 1 - linked / all_pairs, "residual": over_left, "paper": over_left}[variant]
    mass = F.col("top5") / {"original": n, "residual": F.greatest(F.lit(1.0), left), "paper": n}[variant]
    out = states.withColumns({"gcc": F.col("largest") / n, "top5_mass": mass, "hhi": hhi, "ec": ec, "pd": pairs})
    return out.withColumn("cnbi", F.col("pd") * F.col("ec") / (1 + F.col("top5_mass")))


def with_running(states: DataFrame) -> DataFrame:
    """running_r and running_cnbi: means of gcc and cnbi so far."""
    w = Window.partitionBy("graph", "method").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return states.withColumns({"running_r": F.avg("gcc").over(w), "running_cnbi": F.avg("cnbi").over(w)})


def normalised_area(curves: DataFrame, keys: list[str], x: str, y: list[str], floor: float | None = None) -> DataFrame:
    """auc_<y> per curve: trapezoids over the span of x; the value itself for one point, the mean for no span.

    With ``floor`` the span is at least that, and one point gives its value.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    stepped = curves.withColumn("_dx", F.col(x) - F.lag(x).over(w))
    stepped = stepped.withColumns({f"_a_{c}": F.col("_dx") * (F.col(c) + F.lag(c).over(w)) / 2 for c in y})
    span = F.max(x) - F.min(x)
    many = (F.count(F.lit(1)) > 1) if floor is not None else (span > 0)
    wide = F.greatest(span, F.lit(floor)) if floor is not None else span
    return stepped.groupBy(*keys).agg(*[F.when(many, F.sum(f"_a_{c}") / wide).otherwise(F.avg(c)).alias(f"auc_{c}") for c in y])


def summaries(states: DataFrame, early: float = 0.20) -> DataFrame:
    """(graph, method, steps, r, auc_acc, auc_ncc, auc_cnbi, final_*, early_*) of states with metrics.

    early_* are of the first step whose ratio is nearest to ``early``.
    """
    keys = ["graph", "method"]
    areas = normalised_area(states, keys, "removal_ratio", ["gcc", "ncc", "cnbi"]).withColumnRenamed("auc_gcc", "auc_acc")
    near = F.struct(F.abs(F.col("removal_ratio") - early), F.col("step"))
    ends = states.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.avg("gcc").alias("r"),
        *[F.max_by(c, "step").cast("double").alias(f"final_{c}") for c in ("gcc", "ncc", "cnbi")], *[F.min_by(c, near).cast("double").alias(f"early_{c}") for c in ("gcc", "ncc", "cnbi")],
    )
    return ends.join(areas, keys)


def plain_means(states: DataFrame) -> DataFrame:
    """(graph, method, r, cnbi, top5_mass, hhi, pd): means over all steps, for the residual variant."""
    return states.groupBy("graph", "method").agg(F.avg("gcc").alias("r"), *[F.avg(c).alias(c) for c in ("cnbi", "top5_mass", "hhi", "pd")])


def value_at(states: DataFrame, column: str, ratio: float) -> DataFrame:
    """(graph, method, value) at the first step nearest to ``ratio``."""
    return states.groupBy("graph", "method").agg(F.min_by(column, F.struct(F.abs(F.col("removal_ratio") - ratio), "step")).cast("double").alias("value"))


def fracture_advantage(summary: DataFrame, baseline: str) -> DataFrame:
    """(method, auc_adv, r_adv, early, worst): gains over the method ``baseline`` of the same graph, mean over graphs."""
    base = summary.where(F.col("method") == baseline).select("graph", *[F.col(c).alias(f"b_{c}") for c in ("auc_cnbi", "r", "early_cnbi", "early_ncc", "early_gcc")])
    rows = summary.where(F.col("method") != baseline).join(base, "graph")
    gain = F.col("auc_cnbi") - F.col("b_auc_cnbi")
    early = 0.45 * (F.col("early_cnbi") - F.col("b_early_cnbi")) + 0.35 * (F.col("early_ncc") - F.col("b_early_ncc")) + 0.20 * 100 * (F.col("b_early_gcc") - F.col("early_gcc"))
    return rows.groupBy("method").agg(F.avg(gain).alias("auc_adv"), F.avg(F.col("b_r") - F.col("r")).alias("r_adv"), F.avg(early).alias("early"), F.min(gain).alias("worst"))


def mean_over_graphs(summary: DataFrame) -> DataFrame:
    """(method, graphs, means of all summary columns)."""
    columns = [c for c in summary.columns if c not in ("graph", "method", "steps")]
    return summary.groupBy("method").agg(F.count(F.lit(1)).alias("graphs"), *[F.avg(c).alias(c) for c in columns])
