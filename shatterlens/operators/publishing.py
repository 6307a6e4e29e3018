"""Result tables: refresh, audit, nearest matches, stride samples, text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shatterlens.functions.scalars import near


def refreshed(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the rows of the keys in ``new`` replaced by those of ``new``; columns are matched by name."""
    kept = table.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def audited(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerances: dict[str, float]) -> DataFrame:
    """(keys, column, expected, actual, status): ``ok``, ``differs`` or ``missing`` for every expected cell."""
    other = actual.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in tolerances], F.lit(True).alias("_there"))
    both = expected.join(other, list(keys), "left")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("expected"), F.col(f"_a_{c}").alias("actual"),
                 F.when(F.col("_there").isNull(), "missing").when(near(F.col(c).cast("double"), F.col(f"_a_{c}"), t), "ok").otherwise("differs").alias("status"))
        for c, t in tolerances.items()
    ])
    return both.select(*keys, F.inline(cells))


def nearest_within(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tie: str, tolerance: float) -> DataFrame:
    """Each row of ``a`` with the row of ``b`` of the same keys nearest in ``value`` (at most ``tolerance`` away, first ``tie`` wins).

    Values are cut into cells as wide as the tolerance. Of each distinct value only the next one below and above are looked
    at, in its cell or at the ends of the cells beside it, so no pairs are listed, however many rows share a value. Columns of b get _b.
    """
    known = lambda df: df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_cell", F.floor(F.col(value) / tolerance))
    others = [c for c in b.columns if c not in (*keys, value, tie)]
    row = F.struct(F.col(tie), F.col(value), *others)
    firsts = known(b).groupBy(*keys, "_cell", value).agg(F.min(row).alias("_b"))
    wanted = known(a).select(*keys, "_cell", value).distinct()
    ends = firsts.groupBy(*keys, "_cell").agg(F.max(F.struct(value, "_b"))["_b"].alias("_high"), F.min(F.struct(value, "_b"))["_b"].alias("_low"))
    # Two cells: a quotient may be rounded across an edge.
    ends = ends.withColumn("_by", F.explode(F.array(*[F.lit(i) for i in (-2, -1, 1, 2)]))).withColumn("_cell", F.col("_cell") + F.col("_by"))
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.{value}"), F.col(c).alias("_b")))
    beside = ends.groupBy(*keys, "_cell").agg(F.max(F.when(F.col("_by") > 0, place("_high")))["_b"].alias("_under"), F.min(F.when(F.col("_by") < 0, place("_low")))["_b"].alias("_over"))
    points = wanted.join(firsts, [*keys, "_cell", value], "full")
    w = Window.partitionBy(*keys, "_cell")
    points = points.withColumn("_below", F.last("_b", ignorenulls=True).over(w.orderBy(F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)))
    points = points.withColumn("_above", F.last("_b", ignorenulls=True).over(w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)))
    points = points.join(beside, [*keys, "_cell"], "left")
    gap = lambda c: F.abs(F.col(value) - F.col(f"{c}.{value}"))
    met = F.array_min(F.array(*[F.when(gap(c) <= tolerance, F.struct(gap(c).alias("gap"), F.col(c).alias("_b"))) for c in ("_below", "_above", "_under", "_over")]))
    found = points.select(*keys, value, met.alias("_met")).where(F.col("_met").isNotNull())
    rest = [c for c in b.columns if c not in keys]
    found = found.select(*keys, value, *[F.col("_met._b")[c].alias(f"{c}_b") for c in rest], F.col("_met.gap").alias("gap"))
    return a.join(found, [*keys, value]).select(*a.columns, *[f"{c}_b" for c in rest], "gap")


def strided(rows: DataFrame, keys: Sequence[str], order: str, wanted: int) -> DataFrame:
    """Every max(1, n // wanted)-th row of each key, from the first: a sampling operator for curves."""
    w = Window.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / wanted))
    return rows.withColumn("_n", F.row_number().over(w.orderBy(order)) - 1).withColumn("_s", step).where("_n % _s = 0").drop("_n", "_s")


def hidden_cases(curves: DataFrame, tolerance: float, gap: float, wanted: int | None = 180) -> DataFrame:
    """Pairs of steps of two methods on a graph with gcc within ``tolerance`` but cnbi at least ``gap`` apart.

    Curves are thinned to about ``wanted`` steps each, or not at all with None; a step of the first method (by name) meets
    the nearest step of the second, the earlier of two.
    """
    thin = (curves if wanted is None else strided(curves, ["graph", "method"], "step", wanted)).select("graph", "method", "step", "gcc", "cnbi")
    names = thin.select("graph", "method").distinct()
    pairs = names.select("graph", F.col("method").alias("method_a")).join(names.select("graph", F.col("method").alias("method_b")), "graph").where(F.col("method_a") < F.col("method_b"))
    a = thin.withColumnRenamed("method", "method_a").join(pairs, ["graph", "method_a"])
    b = thin.withColumnRenamed("method", "method_b").join(pairs, ["graph", "method_b"])
    met = nearest_within(a, b, ["graph", "method_a", "method_b"], "gcc", "step", tolerance)
    out = met.withColumn("hidden_gap", F.abs(F.col("cnbi") - F.col("cnbi_b"))).where(F.col("hidden_gap") >= gap)
    return out.select("graph", "method_a", "method_b", F.col("step").alias("step_a"), F.col("step_b"), F.col("gcc").alias("gcc_a"), "gcc_b", F.col("cnbi").alias("hidden_score_a"), F.col("cnbi_b").alias("hidden_score_b"), F.col("gap").alias("gcc_abs_diff"), "hidden_gap")


def fixed_cases(cases: DataFrame, wanted: DataFrame, keys: Sequence[str], difference: str = "gcc_abs_diff", most: float = 1e-12) -> DataFrame:
    """The case of every row of wanted(keys...), a short list; a ValueError names those that are missing or whose ``difference`` is beyond ``most``."""
    found = F.broadcast(wanted.select(*keys)).join(cases.withColumn("_there", F.lit(True)), list(keys), "left")
    bad = found.where(F.col("_there").isNull() | (F.abs(F.col(difference)) > most)).select(*keys).limit(5).collect()
    if bad:
        raise ValueError(f"missing or not exact: {[tuple(r) for r in bad]}")
    return found.drop("_there")


def mapped(rows: DataFrame, column: str, values: dict[str, str], otherwise: str | None = None) -> DataFrame:
    """``rows`` with the values of a text column exchanged; others stay, or become ``otherwise``."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return rows.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(otherwise) if otherwise is not None else F.col(column)))


def means_by_size(rows: DataFrame, ok: Column, values: Sequence[str], keys: Sequence[str] = ("method", "n")) -> DataFrame:
    """(keys, runs, means of ``values``) of the rows that are ``ok``."""
    return rows.where(F.coalesce(ok, F.lit(False))).groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *[F.avg(c).alias(f"mean_{c}") for c in values])


def completeness(rows: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """(keys, total, done, complete) of each group."""
    done = F.sum(F.coalesce(ok, F.lit(False)).cast("bigint"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), done.alias("done")).withColumn("complete", F.col("total") == F.col("done"))


def markdown_rows(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line): each row as a row of a pipe table."""
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("line"))


def replace_table(document: str, header: str, table: str) -> str:
    """A text with the pipe table that starts with ``header`` exchanged; ValueError if there is none."""
    lines = document.splitlines()
    start = next((i for i, x in enumerate(lines) if x.strip() == header.strip()), None)
    if start is None:
        raise ValueError("no such table")
    end = start
    while end < len(lines) and lines[end].lstrip().startswith("|"):
        end += 1
    return "\n".join([*lines[:start], *table.splitlines(), *lines[end:]]) + "\n"


def ratio_to(rows: DataFrame, label: str, base: str, columns: dict[str, str], inverse: Sequence[str] = ()) -> DataFrame:
    """Ratios of columns to those of the row labelled ``base`` (one row); ``inverse`` ones are base / own."""
    one = rows.where(F.col(label) == base).select(*[F.col(c).alias(f"_b_{c}") for c in columns]).limit(1)
    joined = rows.crossJoin(F.broadcast(one))
    own = {n: (F.col(f"_b_{c}") / F.col(c) if c in inverse else F.col(c) / F.col(f"_b_{c}")) for c, n in columns.items()}
    return joined.withColumns(own).drop(*[f"_b_{c}" for c in columns])
