import numpy as np
from pyspark.sql import functions as F

from shatterlens.llm.mixing import mix_report, mix_sources, pivot

TARGETS = "source string, target_share double, max_repeats int, id string"
SIZES = "id bigint, source string, n_tokens bigint"


def test_pivot_keeps_mass_and_expectation():
    size = np.array([5, 3, 8, 1, 2, 9, 4.0])
    start = np.full(7, 0.4)
    total = np.zeros(7)
    for seed in range(4000):
        p = pivot(start, size, np.random.default_rng(seed))
        assert abs((p * size).sum() - (start * size).sum()) < 1e-6
        assert ((p > 0) & (p < 1)).sum() <= 1
        total += p
    assert np.abs(total / 4000 - 0.4).max() < 0.04


def test_outsized_documents_do_not_miss_the_target():
    size = np.array([20_000.0, 9_000, *[300 + i for i in range(400, 0, -1)], *range(90, 0, -1)])
    worst, total = 0.0, np.zeros(len(size))
    for seed in range(1500):
        p = pivot(np.full(len(size), 0.42), size, np.random.default_rng(seed))
        assert abs((p * size).sum() - 0.42 * size.sum()) < 1e-4
        inner = (p > 0) & (p < 1)
        worst = max(worst, (size[inner]).max(initial=0))
        total += p
    assert worst < 1000 and np.abs(total / 1500 - 0.42).max() < 0.06


def test_shares_caps_and_partitions(spark):
    sizes = spark.range(3000).select("id", F.expr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then 'small' when id % 7 = 0 then null else 'other' end").alias("source"), (F.col("id") % 40).alias("n_tokens"))
    targets = spark.createDataFrame([("hot", 0.2, 2, ""), ("small", 0.3, 3, ""), ("other", 0.5, 4, ""), ("none", 0.1, 2, ""), (None, 0.1, 1, "")], TARGETS)
    mix = mix_sources(sizes, targets, bucket_rows=100, fan_in=3)
    rows = sorted(tuple(r) for r in mix.collect())
    assert rows == sorted(tuple(r) for r in mix_sources(sizes.repartition(7), targets, bucket_rows=100, fan_in=3).collect())
    assert all(r[2] > 0 and r[3] >= 1 for r in rows) and len({r[0] for r in rows}) == len(rows)
    report = {r.source: r for r in mix_report(sizes, targets, mix).collect()}
    total = sum(i % 40 for i in range(3000))
    for name, r in report.items():
        due = min(r.max_repeats * r.tokens, r.target_share * total)
        assert abs(r.tokens_drawn - due) < 40, name
        assert r.most_copies <= r.max_repeats and r.total == total
    assert report["none"].tokens_drawn == 0 and report["small"].most_copies == 3


def test_every_document_keeps_its_expectation(spark):
    sizes = spark.range(40).select("id", F.lit("s").alias("source"), (F.col("id") + 1).alias("n_tokens"))
    targets = spark.createDataFrame([("s", 0.5, 1, "")], TARGETS)
    drawn = [{r.id for r in mix_sources(sizes, targets, seed=s, bucket_rows=10).collect()} for s in range(6)]
    assert len({frozenset(d) for d in drawn}) > 1


def test_dirty_and_empty(spark):
    targets = spark.createDataFrame([("a", None, None, ""), ("b", 0.6, None, ""), ("b", 0.4, None, "")], TARGETS)
    sizes = spark.createDataFrame([(1, "a", 3), (2, "b", 5), (2, "b", 5), (3, "b", 0), (None, "b", 5)], SIZES)
    got = sorted((r.id or 0, r.copies) for r in mix_sources(sizes, targets).collect())
    assert got == [(0, 1), (2, 1), (2, 1)]
    empty = spark.createDataFrame([], SIZES)
    assert mix_sources(empty, targets).count() == 0
    assert [r.share_reached for r in mix_report(empty, targets, mix_sources(empty, targets)).collect()] == [0.0, 0.0]
    assert mix_sources(sizes, targets.limit(0)).count() == 0
