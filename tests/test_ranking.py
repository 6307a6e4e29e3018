import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shatterlens.functions import features as fe, scalars as sc
from shatterlens.functions.programs import StubProvider, program_id, static_error
from shatterlens.operators import adaptive, policies as po, publishing as pb, ranking as rk
from shatterlens.operators.components import connected_components
from shatterlens.operators.records import current_rows
from shatterlens.operators.skew import lookup_join
from shatterlens.operators.windows import average_rank, global_average_rank, numbered, running_sum


def test_average_rank_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("a", None), ("b", 5.0)], "k string, x double")
    got = sorted((r.k, r.x or -1, r.rank) for r in df.select("k", "x", average_rank(F.col("x"), ["k"], True).alias("rank")).collect() if r.x is not None)
    assert got == [("a", 1.0, 4.0), ("a", 2.0, 2.5), ("a", 2.0, 2.5), ("a", 3.0, 1.0), ("b", 5.0, 1.0)]
    everywhere = {(r.k, r.x): r.rank for r in global_average_rank(df, "x", "rank").collect()}
    assert everywhere["a", 2.0] == 2.5 and everywhere["b", 5.0] == 5 and everywhere["a", None] is None


def test_running_sum_over_many_tasks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") * 7 % 11).alias("x")).repartition(5)
    got = {r.id: r.s for r in running_sum(df, ["k"], ["id"], "x", "s").collect()}
    for k in range(3):
        total = 0
        for i in range(k, 500, 3):
            total += i * 7 % 11
            assert got[i] == total
    assert running_sum(df.limit(0), ["k"], ["id"], "x", "s").count() == 0


@pytest.mark.parametrize("plain_rows", [0, 10, 10_000])
def test_numbering(spark, plain_rows):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), (F.col("id") * 17 % 101).alias("x"), "id", F.lit("z").alias("_part"))
    got = {r.id: r.n for r in numbered(df, ["k"], [F.desc("x"), F.asc("id")], "n", plain_rows).collect()}
    for k in (0, 1):
        own = sorted((i for i in range(300) if i % 2 == k), key=lambda i: (-(i * 17 % 101), i))
        assert [got[i] for i in own] == list(range(1, 151))
    assert numbered(df.limit(0), ["k"], [F.asc("id")], "n", plain_rows).count() == 0


def test_pareto_is_what_it_says_and_idempotent(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, float("nan"), round(rng.random(), 1)]), round(rng.random(), 1), round(rng.random(), 1), rng.random() < 0.9, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, auc double, r double, t double, valid boolean, id int").repartition(6)
    front = rk.pareto(df, ["k"], ["auc"], ["r", "t"])
    fit = [r for r in rows if r[4] and r[1] is not None and r[1] == r[1]]
    beats = lambda a, b: a[0] == b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3] and a[1:4] != b[1:4]
    want = {r[5] for r in fit if not any(beats(o, r) for o in fit)}
    assert {r.id for r in front.collect()} == want
    assert {r.id for r in rk.pareto(front, ["k"], ["auc"], ["r", "t"]).collect()} == want
    assert rk.pareto(df.limit(0), ["k"], ["auc"], ["r", "t"]).count() == 0


def test_published_pareto_example(spark):
    df = spark.createDataFrame([("a", 10.0, 0.4, 1.0), ("b", 9.0, 0.3, 2.0), ("c", 8.0, 0.5, 3.0), ("d", 10.0, 0.4, 1.0)], "method string, auc_cnbi double, r double, time_s double").withColumn("valid", F.lit(True))
    front = rk.pareto(df, [], ["auc_cnbi"], ["r", "time_s"])
    assert {r.method for r in front.collect()} == {"a", "b", "d"}
    picks = {r.pick: r.method for r in rk.final_pick(front.withColumn("k", F.lit(0)), ["k"]).collect()}
    assert picks == {"Q": "a", "S": "a"}


def test_gate_opens_on_known_checks_only(spark):
    means = spark.createDataFrame([("Q", 10.0, 0.2, 1.0), ("S", 8.0, 0.3, 0.5), ("N", None, None, None)], "method string, mean_auc_cnbi double, mean_r double, mean_time_s double")
    refs = spark.createDataFrame([("q", 9.0, 0.25, 1.2), ("s", 7.0, None, 0.6)], "label string, ref_auc_cnbi double, ref_r double, ref_time_s double")
    got = {(r.method, r.label): r.passes for r in rk.gate(means, refs).collect()}
    assert got == {("Q", "q"): True, ("Q", "s"): False, ("S", "q"): False, ("S", "s"): True, ("N", "q"): False, ("N", "s"): False}


def test_unit_ranks_against_pandas(spark):
    values = [3.0, None, 1.0, 3.0, 2.0]
    s = pd.Series(values)
    ranks = s.rank(method="average", ascending=False)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").withColumn("k", F.lit(0))
    rows = {r.i: r for r in df.select("i", *[rk.unit_rank(F.col("x"), ["k"], True, a).alias(a) for a in ("rows", "coerced", "known")]).collect()}
    for i, rank in enumerate(ranks):
        if math.isnan(rank):
            assert (rows[i]["rows"], rows[i]["coerced"], rows[i]["known"]) == (None, 0.0, 0.0)
        else:
            assert rows[i]["rows"] == rows[i]["coerced"] == pytest.approx(1 - (rank - 1) / 4)
            assert rows[i]["known"] == pytest.approx(1 - (rank - 1) / 3)


def test_quota_and_schedule():
    assert rk.quota_counts(24) == {"Q": 8, "S": 6, "B": 6, "R": 4} and sum(rk.quota_counts(5).values()) == 5
    for budget in (1, 3, 4, 7, 50, 200, 333):
        assert len(po.branch_schedule(budget)) == budget
    assert po.branch_schedule(200).count("Q") == 60


def test_credit_is_the_fold(spark):
    rng = random.Random(2)
    rewards = [rng.uniform(-1, 1) for _ in range(30)]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(rewards)], "family string, idx int, reward double")
    plain, floored = 0.1, 0.05
    for x in rewards:
        plain, floored = 0.82 * plain + 0.18 * x, max(0.005, 0.86 * floored + 0.14 * x)
    assert po.moving_credit(df, ["family"], ["idx"], start=0.1).first().credit == pytest.approx(plain)
    assert po.floored_credit(df, ["family"], "idx").first().credit == pytest.approx(floored)


def test_draws_are_reproducible_and_weighted(spark):
    pool = spark.range(4000).select((F.col("id") % 1000).cast("string").alias("run_id"), F.when(F.col("id") < 1000, "heavy").otherwise(F.concat(F.lit("n"), F.floor(F.col("id") / 1000).cast("string"))).alias("node_id"))
    draw = po.uniform_draw(pool, "run_id", weight=F.when(F.col("node_id") == "heavy", 3.0).otherwise(1.0))
    counts = {r.node_id: r["count"] for r in draw.groupBy("node_id").count().collect()}
    assert sum(counts.values()) == 1000 and 420 < counts["heavy"] < 580
    clades = spark.createDataFrame([("r", "a", 5, 5, 0), ("r", "b", 5, 0, 5)], "run_id string, clade string, n bigint, wins bigint, losses bigint")
    assert po.clade_choice(clades).collect() == po.clade_choice(clades).collect()
    for clade, own in po.CLADES.items():
        blend = po.random_blend(clade, 1)
        assert blend == po.random_blend(clade, 1) and all(getattr(blend, w) >= 0.5 for w in own)
    assert po.mutated(adaptive.REFERENCE_BLEND, 3) == po.mutated(adaptive.REFERENCE_BLEND, 3) != adaptive.REFERENCE_BLEND


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(4)
    a = [("k", i, round(rng.random(), 3)) for i in range(60)]
    b = [("k", i, round(rng.random(), 3)) for i in range(40)]
    left, right = (spark.createDataFrame(x, "k string, id int, v double") for x in (a, b))
    got = {r.id: r.id_b for r in pb.nearest_within(left, right, ["k"], "v", "id", 0.01).collect()}
    want = {}
    for _, i, v in a:
        near = [(abs(v - w), j) for _, j, w in b if abs(v - w) <= 0.01]
        if near:
            want[i] = min(near)[1]
    assert got == want


def test_refresh_audit_ratio_markdown(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "method string, x double")
    new = spark.createDataFrame([("b", 3.0, "n"), ("c", 4.0, "n")], "method string, x double, note string")
    assert sorted(tuple(r) for r in pb.refreshed(old.withColumn("note", F.lit("o")), new, ["method"]).collect()) == [("a", 1.0, "o"), ("b", 3.0, "n"), ("c", 4.0, "n")]
    got = {(r.method, r.status) for r in pb.audited(old, new.where("method = 'b'"), ["method"], {"x": 0.5}).collect()}
    assert got == {("a", "missing"), ("b", "differs")}
    assert {r.method: r.q for r in pb.ratio_to(old, "method", "a", {"x": "q"}).collect()} == {"a": 1.0, "b": 2.0}
    assert [r.line for r in pb.markdown_rows(old.orderBy("method"), ["method", "x"]).collect()] == ["| a | 1.0 |", "| b | 2.0 |"]
    assert pb.replace_table("t\n| h |\n|---|\n| 1 |\nend", "| h |", "| n |\n|---|") == "t\n| n |\n|---|\nend\n"
    with pytest.raises(ValueError):
        pb.replace_table("none", "| h |", "x")


def test_components_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (7, None)]
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
        label = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
        for _ in label:
            for a, b in pairs:
                if a in label and b in label and a is not None and b is not None and a != b:
                    label[a] = label[b] = min(label[a], label[b])
        assert got == label
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_lookup_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 5 == 0 else str(i), "x") for i in range(100)], "id int, k string, note string")
    right = spark.createDataFrame([("hot", 1), ("2", 2), (None, 3)], "k string, v int")
    for least in (10, 10_000):
        got = {r.id: r.v for r in lookup_join(left, right, ["k"], 100, share=0.1, least=least).collect()}
        assert len(got) == 100 and got[1] == 1 and got[2] == 2 and got[10] is None and got[4] is None


def test_current_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 2, "x"), (None, 5, "y"), ("b", None, "z")], "k string, t int, v string")
    assert {(r.k, r.v, r.first) for r in current_rows(df, ["k"], "t", ["v"], "first").collect()} == {("a", "x", 1), (None, "y", 5), ("b", "z", None)}


def test_scalar_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("c")).first().c
    text = lambda s: F.lit(s)
    assert value(sc.measure(text("**1234.5 s**"))) == 1234.5 and value(sc.measure(text("timeout guard"))) is None and value(sc.measure(text("5x"))) is None and value(sc.measure(text("timeout"))) is None and value(sc.measure(text("90 %"))) == 90
    assert value(sc.truthy(text(" Yes "))) and not value(sc.truthy(text("ok"))) and value(sc.truthy(text("ok"), "wide")) and not value(sc.truthy(F.lit(None)))
    assert value(sc.snap(F.lit(7.0), [1.0, 5.0, 9.0])) == 5.0
    assert value(sc.near(F.lit(None).cast("double"), F.lit(None).cast("double"), 0.1)) and not value(sc.near(F.lit(1.0), F.lit(None).cast("double"), 9.0))
    assert value(sc.json_object(text('say {"a": {"b": 1}} now'))) == '{"a": {"b": 1}}' and value(sc.json_object(text("no"))) is None
    assert value(sc.fenced_code(text("```\nx\n``` ```Python\ndef degree_order(G):\n  1\n```\nbye"))) == "def degree_order(G):\n  1"
    assert value(sc.fenced_code(text(" y\n"))) == "y" and value(sc.fenced_code(text("so: def degree_order(G): 2 "))) == "def degree_order(G): 2"
    assert value(sc.finite(text("inf"))) is None and value(sc.finite_or(text("abc"), 2)) == 2.0 and value(sc.finite(text("1.5"))) == 1.5
    assert value(sc.compressed_log(F.lit(0.1))) == pytest.approx(-0.35) and value(sc.compressed_log(F.lit(100.0))) == 2
    assert value(sc.top_sum(F.array(*[F.lit(float(x)) for x in (1, 9, 3, 4, 5, 6, 7)]))) == 31
    assert value(sc.list_items(text("a, ,b ,"))) == ["a", "b"] and value(sc.slug(text("-a b/c_"))) == "-a_b_c"
    assert len(value(sc.head_and_tail(text("x" * 500), 100))) == 105 and value(sc.hash_prefix(text("x"))) == program_id("x")


def test_features(spark):
    code = "import heapq\ndef degree_order(G):\n    for v in G.neighbors(u):\n        for w in G.neighbors(v):\n            core = 1\n"
    df = spark.createDataFrame([(code,), ("x = 1",)], "code string")
    flags = fe.main_flags(F.col("code"))
    a, b = df.select(*[c.alias(k) for k, c in flags.items()], fe.signature(flags).alias("s"), fe.contract_violation(F.col("code")).alias("why"), fe.generic_signature(F.col("code")).alias("g")).collect()
    assert a.unbounded_two_hop and a.neighbor_calls == 2 and a.heap_update and a.why == "unbounded two-hop scan" and a.g == "heap+core+neighbor"
    assert b.s == "plain" and b.why == "" and b.g == "simple"


def test_programs_are_checked():
    stub = StubProvider().generate("x", 2)
    assert len(stub) == 2 and static_error(stub[0]) == ""
    assert static_error("import scipy\n" + stub[0]) == "import: scipy" and static_error("def degree_order(:").startswith("syntax") and static_error("x = 1") == "missing: degree_order"
    assert static_error("  def degree_order(G):\n      return OS.path") == "forbidden: os."
    assert static_error("def degree_order(G):\n    return eval('G')").startswith("forbidden")
    assert static_error(stub[0] + "\nprint(1)\n", strict=True) == "statement on top" and static_error('"""doc"""\n' + stub[0], strict=True) == ""


def test_undominated_of_many_points():
    points = np.random.default_rng(0).integers(0, 6, (300, 3)).astype(float)
    keep = rk._undominated(points)
    for i, p in enumerate(points):
        assert keep[i] == (not ((points <= p).all(axis=1) & (points < p).any(axis=1)).any())


def test_bound_policies(spark):
    import json

    from shatterlens.operators import bounds as bo

    said = [
        {"allowed_signals": ["Two-Hop", "degree", "global degree", {"signal": "phase"}, 3, {"x": "y"}, "core number"], "preferred_families": "a b!c", "cap_bounds": {"bounded_two_hop_required": False, "a b": 1}},
        {"preferred_families": ["x", "x", "unbounded", "--", {"name": "y z"}], "forbidden_patterns": ["a BFS", {"pattern": "shortest"}], "cap_bounds": {"c": [1, None, *range(20)], "d": {"e!": 2, "f": None}, "g": [], "": 3, "h": None}},
        {"cap_bounds": {"a_b": "late", "max_neighbor_scan": 9}, "update_bounds": {"mode": "m", "affected_scope": "all", "strategy": [1], "other": 1}},
    ]
    stats = spark.createDataFrame([("s", ["unknown", "f"], 2.0), ("t", [], 0.05)], "scope string, families array<string>, runtime_cap double")
    rows = [("s", i + 1, json.dumps(p)) for i, p in enumerate(said)] + [("s", 4, "no json"), ("s", 11, json.dumps({"preferred_families": ["late"]})), ("u", 1, "{}")]
    got = bo.bound_policies(stats, spark.createDataFrame(rows, "scope string, proposal int, policy string")).collect()
    of = lambda scope, part: [(r.item, r.value) for r in sorted((r for r in got if (r.scope, r.part) == (scope, part)), key=lambda r: (r.place or 0, r.item))]
    assert [f for f, _ in of("s", "family")] == ["f", "a-b-c", "x", "y-z"] and of("t", "family") == [("degree-local", None)]
    assert {x for x, _ in of("s", "signal")} == {*bo.BASE_SIGNALS, *bo.ALWAYS_ALLOWED, "core_number"}
    assert len(of("s", "forbidden")) == len(bo.ALWAYS_FORBIDDEN) and [x for x, _ in of("t", "pruned")] == sorted(bo.PRUNED)
    caps = {k: json.loads(v) for k, v in of("s", "cap")}
    assert caps.pop("target_family_cap_contract") == bo.BRANCH_CAPS
    assert caps == {"max_neighbor_scan": 9, "max_two_hop_scan": 128, "max_candidate_runtime_s_on_proxy": 2.0, "bounded_two_hop_required": True, "forbid_policy_disabling_target_family_signals": True, "phase_schedule_required": True, "a_b": "late", "c": [1, *range(7)], "d": {"e_": 2}, "h": None}
    assert json.loads(dict(of("s", "update"))["mode"]) == "m" and "never full" in dict(of("s", "update"))["affected_scope"] and len(of("s", "update")) == 4
    assert {r.scope for r in got} == {"s", "t"}


def test_service_is_asked_again():
    import json
    import threading
    import urllib.error
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from shatterlens.functions.programs import HttpProvider

    codes, waits = [503, 429, 200, 400], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(codes.pop(0))
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": asked["messages"][-1]["content"] + "!"}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    provider = HttpProvider(f"http://127.0.0.1:{server.server_port}/", "m", sleep=waits.append)
    assert provider.generate("hello", 1) == ["hello!"] and waits == [1.0, 2.0]
    with pytest.raises(urllib.error.HTTPError):
        provider.reply("again")
    server.shutdown()
    server.server_close()
    with pytest.raises(urllib.error.URLError):
        HttpProvider(f"http://127.0.0.1:{server.server_port}/", "m", tries=2, sleep=waits.append).reply("x")
    assert len(waits) == 3


def test_all_faults_of_programs(spark):
    from shatterlens.functions.programs import checked, findings, forbidden_parts

    code = "import scipy\nfrom os.path import join\nprint(1)\ndef other(G):\n    return eval('x')"
    assert [(f.line, f.kind, f.detail) for f in findings(code, strict=True)] == [(0, "missing", "degree_order"), (1, "import", "scipy"), (2, "forbidden", "os."), (2, "import", "os.path"), (3, "statement on top", "Expr"), (5, "forbidden", "eval(")]
    df = spark.createDataFrame([("a", code), ("b", StubProvider.PROGRAM), ("c", None), ("b", StubProvider.PROGRAM)], "id string, code string")
    assert {(r.id, r.kind) for r in checked(df, "id", "code").collect()} == {("a", "missing"), ("a", "import"), ("a", "forbidden"), ("c", "missing")}
    assert df.where("id = 'a'").select(forbidden_parts(F.col("code"))).first()[0] == ["eval(", "os."]


def test_mixed_draws(spark):
    best = spark.range(2000).select(F.col("id").cast("string").alias("run_id"), F.lit("best").alias("node_id"))
    other = best.withColumn("node_id", F.lit("other"))
    got = {r.node_id: r["count"] for r in po.mixed_draw(best, other, "run_id", 0.2).groupBy("node_id").count().collect()}
    assert sum(got.values()) == 2000 and 320 < got["other"] < 480


def test_hidden_cases(spark):
    rows = [("g", "a", 1, 0.500, 10.0), ("g", "a", 2, 0.400, 11.0), ("g", "b", 1, 0.501, 30.0), ("g", "b", 2, 0.499, 50.0), ("g", "b", 3, 0.3, 90.0), ("h", "a", 1, 0.5, 99.0)]
    cases = pb.hidden_cases(spark.createDataFrame(rows, "graph string, method string, step int, gcc double, cnbi double"), 0.003, 15.0).collect()
    assert [(r.graph, r.method_a, r.method_b, r.step_a, r.step_b, r.hidden_gap) for r in cases] == [("g", "a", "b", 1, 1, 20.0)]


def test_policies_are_plug_ins(spark):
    from shatterlens.operators import plugins

    rows = [("r", f"n{i}", i, i != 3, float(i % 5), "n0" if i else None, f"f{i % 2}") for i in range(9)]
    records = spark.createDataFrame(rows, "run_id string, node_id string, idx int, valid boolean, rank_score double, parent_id string, family string")
    for name in list(plugins.POLICIES):
        (row,) = plugins.propose(records, name).collect()
        assert row.node_id != "n3" and row.examples == ["n4", "n8", "n2"] and row.hint, name
        assert [row] == plugins.propose(records, name).collect()
    plugins.register(plugins.SearchPolicy("last", lambda r, seed: r.where("valid").orderBy(F.desc("idx")).limit(1)))
    try:
        assert plugins.propose(records, "last").first().node_id == "n8"
        with pytest.raises(ValueError):
            plugins.register(plugins.SearchPolicy("last"))
    finally:
        del plugins.POLICIES["last"]


def test_draws(spark):
    from shatterlens.operators import draws as dr

    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    u, z = np.array(df.select(dr.unit(F.col("k"), 1), dr.normal(F.col("k"), 2)).collect()).T
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit(3).cast("bigint").alias("a"), F.lit(5).cast("bigint").alias("b"))
    theta = np.array([r.theta for r in dr.beta(rows, ["k"], "a", "b").collect()])
    assert len(theta) == 3000 and abs(theta.mean() - 3 / 8) < 0.01 and abs(theta.var() - 15 / (64 * 9)) < 0.003


def test_fixed_cases_and_values(spark):
    cases = spark.createDataFrame([("g", 1, 0.0), ("g", 2, 1e-9)], "graph string, step int, gcc_abs_diff double")
    wanted = spark.createDataFrame([("g", 1)], "graph string, step int")
    assert pb.fixed_cases(cases, wanted, ["graph", "step"]).count() == 1
    for bad in (("g", 2), ("h", 1)):
        with pytest.raises(ValueError):
            pb.fixed_cases(cases, spark.createDataFrame([bad], "graph string, step int"), ["graph", "step"])
    assert [r.graph for r in pb.mapped(cases, "graph", {"g": "x"}).collect()] == ["x", "x"]
    assert [r.graph for r in pb.mapped(cases, "graph", {"y": "x"}, "z").collect()] == ["z", "z"]


def test_nearest_of_many_equal_values_lists_no_pairs(spark):
    n = 200_000  # pairs of them would be 4e10
    side = lambda shift: spark.range(n).selectExpr("'g' as g", f"id + {shift} as k", "cast(id % 2 as double) as x")
    rows = pb.nearest_within(side(0), side(7), ["g"], "x", "k", 1e-9).groupBy("x", "x_b", "k_b", "gap").count().collect()
    assert {tuple(r) for r in rows} == {(0.0, 0.0, 7, 0.0, n // 2), (1.0, 1.0, 8, 0.0, n // 2)}


def test_nearest_equals_a_search_of_all(spark):
    import random

    rng = random.Random(5)
    some = lambda n: [(rng.choice("pq"), i, rng.choice([None, float("nan")] + [round(rng.uniform(-2, 2), 2) for _ in range(9)])) for i in range(n)]
    a, b = some(300), some(200)
    good = lambda x: x is not None and x == x
    for tolerance in (0.01, 0.05, 1.0):
        want = set()
        for g, i, x in a:
            near = [(abs(x - y), j) for h, j, y in b if h == g and good(x) and good(y) and abs(x - y) <= tolerance]
            want |= {(i, *min(near)[::-1])} if near else set()
        frame = lambda rows: spark.createDataFrame(rows, "g string, k long, x double")
        got = pb.nearest_within(frame(a), frame(b), ["g"], "x", "k", tolerance)
        assert {(r.k, r.k_b, r.gap) for r in got.collect()} == want
