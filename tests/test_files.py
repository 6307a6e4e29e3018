import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shatterlens.sources import files, sinks
from shatterlens.streaming import progress as sp


def test_csv_with_mark_and_nan(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿dataset,r,auc\na,0.5,nan\nb,,2\n".encode())
    rows = files.read_csv(spark, str(tmp_path / "t.csv"), "dataset string, r double, auc double").orderBy("dataset").collect()
    assert [(r.dataset, r.r, r.auc) for r in rows] == [("a", 0.5, None), ("b", None, 2.0)]
    assert files.read_columns(spark, str(tmp_path / "t.csv"), ["r", "none"]).columns == ["r"]


def test_points_round_trip_and_prune(spark, tmp_path):
    points = spark.createDataFrame([("d1", "m1", 2, 0.2), ("d1", "m1", 1, 0.1), ("d2", "m 2", 1, 0.3)], "dataset string, method string, step int, gcc double")
    root = str(tmp_path / "points")
    sinks.write_points(points, root)
    back = files.read_points(spark, root)
    assert sorted(tuple(r) for r in back.select(*points.columns).collect()) == sorted(tuple(r) for r in points.collect())
    plan = back.where("dataset = 'd1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    assert {(r.method, r.rows) for r in sinks.manifest(points, root).collect()} == {("m1", 2), ("m 2", 1)}


def test_log_and_versions(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a")], "idx int, code string")
    sinks.append_log(rows, log)
    sinks.append_log(rows.withColumn("idx", F.lit(2)), log)
    (tmp_path / "log" / "bad.json").write_text("not json\n")
    assert sorted(r.idx for r in files.read_log(spark, log, "idx int, code string").collect()) == [1, 2]
    sinks.write_version(rows, str(tmp_path / "v"), "1")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_version(rows, str(tmp_path / "v"), "1")
    sinks.write_json({"b": 1, "a": "é"}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": "é", "b": 1} and len(list(tmp_path.glob(".m.json*"))) == 0
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "idx int, code string").first().code == "a"


def test_recorded_order(spark):
    rows = spark.createDataFrame([(0, "9", None), (2, "7.0", "x"), (1, "12", "1.5"), (3, "no", "2")], "step int, removed_node string, total_time_s string")
    assert [(r.step, r.node) for r in files.recorded_order(rows, "g", "m").orderBy("step").collect()] == [(1, 12), (2, 7)]
    assert files.recorded_time(rows).first().seconds == 1.5


def test_markdown_tables_and_programs(spark, tmp_path):
    (tmp_path / "d.md").write_text("# T\n\n| a | b |\n|---|---:|\n| 1 | x y |\n\ntext\n| c |\n| - |\n| 2 |\n")
    got = sorted((r.table, r.row, r.cells) for r in files.read_markdown_tables(spark, str(tmp_path / "d.md")).collect())
    assert got == [(0, 0, ["a", "b"]), (0, 1, ["1", "x y"]), (1, 0, ["c"]), (1, 1, ["2"])]
    (tmp_path / "p.py").write_text("x = 1\n")
    row = files.read_programs(spark, str(tmp_path / "p.py"), "f").first()
    assert row.code == "x = 1\n" and len(row.candidate_id) == 12 and row.path.endswith("p.py")
    parsed = files.parsed_objects(spark.createDataFrame([('see {"k": 3} ok',), ("none",)], "t string"), "t", "k int").collect()
    assert [r.object and r.object.k for r in parsed] == [3, None]


def test_tree_edges(spark):
    rows = spark.createDataFrame([("a", None, 0, True), ("b", "a", 1, False), ("c", "", 2, True)], "node_id string, parent_id string, idx int, valid boolean")
    assert [tuple(r) for r in sinks.tree_edges(rows).collect()] == [("a", "b", 1, False)]


@pytest.mark.parametrize("time", [None, "at"])
def test_credit_survives_batches(spark, tmp_path, time):
    schema = "family string, idx int, reward double, at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = 0.0
    query = lambda: (
        sp.credit_stream(spark.readStream.schema(schema).parquet(source), "family", time=time).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}")).trigger(availableNow=True).start()
    )
    for batch in range(2):
        rows = [("f", batch * 3 + i, float(i + batch), datetime(2024, 1, 1 + batch)) for i in range(3)]
        for r in rows:
            want = 0.82 * want + 0.18 * r[2]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        query().awaitTermination()
    last = spark.read.parquet(out).orderBy(F.desc("n")).first()
    assert last.n == 6 and last.credit == pytest.approx(want)
    spark.createDataFrame([("g", 0, 1.0, datetime(2024, 3, 1))], schema).write.mode("append").parquet(source)
    query().awaitTermination()
    spark.createDataFrame([("f", 9, 1.0, datetime(2024, 3, 2))], schema).write.mode("append").parquet(source)
    query().awaitTermination()
    n = spark.read.parquet(out).where("family = 'f' and n < 8").agg(F.count_if(F.col("n") == 1), F.max("n")).first()
    assert tuple(n) == ((1, 6) if time else (0, 7))


def test_csv_starts_with_a_mark_and_a_table_goes_beside(spark, tmp_path):
    from shatterlens.sources import files, sinks

    df = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfk,v")
    assert files.read_csv(spark, str(tmp_path / "t"), "k string, v int").collect() == df.collect()
    (tmp_path / "file").write_text("x")
    assert sinks.write_or_beside(df, str(tmp_path / "fine"), str(tmp_path / "other")).endswith("fine")
    assert sinks.write_or_beside(df, str(tmp_path / "file" / "below"), str(tmp_path / "other")).endswith("other")
