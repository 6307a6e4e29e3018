from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shatterlens.operators.orphans import orphan_report, plain_path, record_orphans, resolve_references

T0 = datetime(2024, 3, 31, 23)
H = timedelta(hours=1)
RECORDS = "run_id string, node_id string, parent_id string, candidate_file string, logged_at timestamp, ingested_at timestamp, deleted_at timestamp, kind string, _hit string"
FILES = "candidate_file string, ingested_at timestamp, deleted_at timestamp, run_id string"


@pytest.mark.parametrize(
    ("match", "missing"),
    [("simple", {2}), ("partial", {2, 4}), ("full", {2, 3, 4}), ("as_stored", {2, 4, 5})],
)
def test_match_semantics(spark, match, missing):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", None), (4, None, "z"), (5, None, None)], "id int, p string, q string")
    targets = spark.createDataFrame([("a", "x"), ("a", None), ("b", "w"), ("a", "x")], "k string, l string")
    out = resolve_references(refs, ["p", "q"], targets, ["k", "l"], match=match).collect()
    assert len(out) == 5
    assert {r.id for r in out if not r._hit} == missing


def test_hot_keys_join_the_same(spark):
    refs = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    targets = spark.createDataFrame([("hot", 1), ("7", 2), ("7", 3)], "k string, v int")
    plain = resolve_references(refs, ["k"], targets, ["k"], ["v"])
    split = resolve_references(refs, ["k"], targets, ["k"], ["v"], share=0.2, least=10)
    assert sorted(plain.collect()) == sorted(split.collect())
    assert {r.v for r in split.where("_hit").collect()} == {1, 3}


def test_kinds_periods_and_dirty_values(spark):
    records = spark.createDataFrame(
        [
            ("r", "root", None, None, T0, T0, None, "", ""),
            ("r", "gone", "root", "./a//b.py", T0, T0, T0, "", ""),
            ("r", "late", "None", " ", T0, T0 + 5 * H, None, "", ""),
            ("r", "c1", "gone", "a\\b.py", T0 + 2 * H, T0, None, "", ""),
            ("r", "c2", "late", "A/b.py", None, T0, None, "", ""),
            ("r", "c3", "root ", "nan", T0, T0, None, "", ""),
            ("r", "c3", "root", "nan", T0, T0 - H, None, "", ""),
            ("s", "c4", "root", "\t", T0, T0, None, "", ""),
            (None, "c5", "root", "x", T0, T0, None, "", ""),
        ],
        RECORDS,
    )
    files = spark.createDataFrame([("a/b.py", T0, None, ""), (None, T0, None, ""), ("x", T0 - H, T0, ""), ("./x", T0, None, "")], FILES)
    found = record_orphans(records, files)
    got = sorted(tuple(str(v) for v in r) for r in found.collect())
    assert got == sorted([
        ("r", "c1", "parent_id", "deleted", "2024-04"), ("r", "c2", "parent_id", "late", "2024-03"), ("r", "c3", "parent_id", "missing", "2024-03"),
        ("s", "c4", "parent_id", "missing", "2024-03"), ("None", "c5", "parent_id", "missing", "2024-03"), ("r", "c2", "candidate_file", "missing", "2024-03"),
    ])
    assert sum(r.n for r in orphan_report(found).collect()) == len(got)


def test_empty(spark):
    assert record_orphans(spark.createDataFrame([], RECORDS), spark.createDataFrame([], FILES)).count() == 0


def test_paths(spark):
    got = spark.createDataFrame([(".\\a\\\\b",), ("././a",), ("/a",)], "p string").select(plain_path(F.col("p"))).collect()
    assert [r[0] for r in got] == ["a/b", "./a", "/a"]


def test_clashing_names(spark):
    refs = spark.createDataFrame([(1, "a", "x", "y", "z", "w", "v")], "id int, _k0 string, _hit string, _t string, _hot string, _ref string, _c0 string")
    targets = spark.createDataFrame([("a", 7)], "_k0 string, _c0 int")
    row = resolve_references(refs, ["_k0"], targets, ["_k0"], ["_c0"]).first()
    assert row._hit is True and row._c0 == 7 and (row._t, row._hot, row._ref) == ("y", "z", "w")
