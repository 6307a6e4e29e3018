import random

import pytest
from pyspark.sql import functions as F

from shatterlens.llm.topn import top_n_per_group

SCHEMA = "g string, score double, k int, place string, _bin string, _least string, _N string"


def want(rows, n):
    best = {}
    for g in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]), key=lambda r: (-r[1], r[2]))
        best[g] = [(g, i + 1, r[2]) for i, r in enumerate(own[:n])]
    return sorted(x for v in best.values() for x in v)


@pytest.mark.parametrize("hot_share", [1e-9, 0.05, 1.0])
def test_equals_sorting(spark, hot_share):
    rng = random.Random(5)
    score = lambda: rng.choice([None, float("nan"), float("inf"), float("-inf"), 0.5, rng.random(), rng.gauss(0, 100)])
    rows = [(rng.choice([None, "hot", "hot", f"g{rng.randint(0, 60)}"]), score(), i, "x", "y", "z", "w") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = top_n_per_group(df, "g", "score", 6, [F.asc("k")], bins=32, hot_share=hot_share)
    assert sorted((r.g, r.place, r.k) for r in got.collect()) == want(rows, 6)
    assert {(r._bin, r._least, r._N) for r in got.collect()} == {("y", "z", "w")}


def test_one_score_only_and_extra_columns(spark):
    df = spark.createDataFrame([("a", 1.0, i, "p", "b", "", "") for i in range(50)], SCHEMA).withColumnRenamed("place", "other")
    got = top_n_per_group(df, "g", "score", 3, [F.asc("k")]).orderBy("k").collect()
    assert [(r.k, r.place, r.other) for r in got] == [(0, 1, "p"), (1, 2, "p"), (2, 3, "p")]


def test_empty(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA).select("g", "score", "k"), "g", "score", 3, [F.asc("k")]).count() == 0


def test_large_groups_of_one_bin_skip_the_join(spark, monkeypatch):
    from shatterlens.llm import topn

    kept = {}
    save = topn.Scratch.save
    monkeypatch.setattr(topn.Scratch, "save", lambda self, df, name: kept.setdefault(name, save(self, df, name)))
    items = spark.range(300).select("id", F.when(F.col("id") < 200, "tied").otherwise("spread").alias("g"), F.when(F.col("id") < 200, 0.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = topn.top_n_per_group(items, "g", "x", 3, [F.col("id")], hot_share=1 / 10)
    assert {r.g for r in kept["thresholds"].collect()} == {"tied", "spread"}
    assert sorted((r.g, r.place, r.id) for r in got.collect()) == [("spread", 1, 299), ("spread", 2, 298), ("spread", 3, 297), ("tied", 1, 0), ("tied", 2, 1), ("tied", 3, 2)]


def test_bins_never_fall_as_scores_rise(spark):
    import numpy as np

    from shatterlens.llm.topn import score_bin

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), rng.random(3000), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, np.inf, -np.inf]])
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", score_bin(F.col("x"), 256).alias("b")).orderBy("x").collect()
    assert all(p.b <= q.b for p, q in zip(got, got[1:]))
    assert len({r.b for r in got if 0.5 < r.x < 1}) > 200


def test_an_outlier_takes_no_resolution(spark, monkeypatch):
    from shatterlens.llm import topn

    kept = {}
    save = topn.Scratch.save
    monkeypatch.setattr(topn.Scratch, "save", lambda self, df, name: kept.setdefault(name, save(self, df, name)))
    items = spark.range(10_000).select("id", F.lit("g").alias("g"), F.when(F.col("id") == 0, 1e300).otherwise(F.col("id") / 10_000).alias("x"))
    topn.top_n_per_group(items, "g", "x", 5, [F.col("id")]).collect()
    least = kept["thresholds"].first()["_least"]
    assert items.where(topn.score_bin(F.col("x"), topn.BINS) >= least).count() < 100


def test_large_tied_groups_are_limited_before_the_shuffle(spark):
    items = spark.range(50_000).select("id", F.lit("g").alias("g"), F.lit(1.0).alias("x"))
    got = top_n_per_group(items, "g", "x", 5, [F.col("id")])
    assert [r.id for r in got.orderBy("place").collect()] == [0, 1, 2, 3, 4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    hot = plan[: plan.index("cold")] if "cold" in plan else plan
    at = hot.index("WindowGroupLimit")
    assert hot.index("Final", at) < hot.index("Exchange", at) < hot.index("Partial", at)
