import random
import re

import pytest
from pyspark.sql import functions as F

from shatterlens.llm.neardup import fingerprint, near_duplicate_groups, near_duplicate_links, near_duplicates, shingles

SCHEMA = "cid string, code string, family string, id string, items string"


def programs(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out, base = [], []
    for i in range(n):
        if i % 4 == 0 or not base:
            base = [rng.choice(words) for _ in range(rng.randint(25, 150))]
        text = list(base)
        for _ in range(rng.randint(0, 12)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((f"c{i:04d}", " ".join(text).upper() if i % 2 else " ,".join(text), rng.choice(["f", "g", None]), "x", "y"))
    return out


def brute(rows):
    sets = {}
    for c, code, family, *_ in rows:
        w = re.findall(r"[a-z0-9_]+", code.lower()) if code else []
        if c is not None and len(w) >= 20:
            sets[c] = (family, {tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a][0] == sets[b][0] and 10 * len(sets[a][1] & sets[b][1]) >= 7 * len(sets[a][1] | sets[b][1])}


@pytest.mark.parametrize("local_rows, bucket_rows", [(1000, 5000), (5, 5000), (5, 2)])
def test_both_ways_equal_all_pairs(spark, local_rows, bucket_rows):
    rows = programs(1, 200)
    rows += [("copy1", rows[0][1], rows[0][2], "", ""), ("copy2", rows[0][1], rows[0][2], "", ""), rows[3], rows[3]]
    rows += [("short", "a b c", "f", "", ""), ("null", None, "f", "", ""), ("empty", "", "f", "", ""), (None, rows[0][1], "f", "", "")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), "cid", "code", F.col("family"), local_rows=local_rows, bucket_rows=bucket_rows).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows)


def test_recall_at_the_threshold():
    rng = random.Random(2)
    far = []
    for _ in range(300):
        common = [rng.getrandbits(32) for _ in range(140)]
        import numpy as np

        a = np.array(common + [rng.getrandbits(32) for _ in range(30)], dtype=np.uint32)
        b = np.array(common + [rng.getrandbits(32) for _ in range(30)], dtype=np.uint32)
        x, y = (np.frombuffer(fingerprint(v), dtype="<u2") for v in (a, b))
        far.append(np.bitwise_count(x ^ y).min())
    assert sum(d <= 1 for d in far) >= 298


def test_empty_and_very_long(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA), "cid", "code", F.col("family")).count() == 0
    long = " ".join(f"v{i}" for i in range(100_000))
    rows = [("a", long, "f", "", ""), ("b", long + " tail", "f", "", "")]
    assert near_duplicates(spark.createDataFrame(rows, SCHEMA), "cid", "code", F.col("family")).count() == 1


def test_shingles():
    assert shingles(None) is None and shingles("a " * 19) is None
    assert len(shingles("a " * 20)) == 1


@pytest.mark.parametrize("local_rows", [1000, 5])
def test_copies_are_members_not_pairs(spark, local_rows):
    code = " ".join(f"w{i}" for i in range(60))
    rows = [(f"k{i:02d}", code, "f") for i in range(40)] + [(f"n{i:02d}", code + " end", "f") for i in range(40)] + [("alone", " ".join(f"z{i}" for i in range(60)), "f")]
    df = spark.createDataFrame(rows, "cid string, code string, family string")
    links = near_duplicate_links(df, "cid", "code", F.col("family"), local_rows=local_rows)
    assert links.where("link").count() == 1 and links.where("not link").count() == 80
    assert near_duplicates(df, "cid", "code", F.col("family"), local_rows=local_rows).count() == 80 * 79 // 2
    assert {(r.node, r.component) for r in near_duplicate_groups(links).collect()} == {(c, "k00") for c, *_ in rows if c != "alone"}


def test_one_id_with_several_programs(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [("1", a, "f"), ("1", b, "f"), ("2", a, "f"), ("3", b, "f"), ("2", a, "g"), ("4", a, "g")]
    got = near_duplicates(spark.createDataFrame(rows, "cid string, code string, family string"), "cid", "code", F.col("family"))
    assert {tuple(r) for r in got.collect()} == {("1", "2"), ("1", "3"), ("2", "4")}


def test_alike_fingerprints_take_bounded_memory():
    import tracemalloc

    import numpy as np

    from shatterlens.llm import neardup

    n = 3000
    prints = np.zeros((n, neardup.SEGMENTS * neardup.SEGMENT_BITS // 8), dtype=np.uint8)
    prints[np.arange(n), np.arange(n) % prints.shape[1]] = 1
    tracemalloc.start()
    found = sum(len(p) for p in neardup._close(prints))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n * (n - 1) // 2 and peak < 400e6


def test_a_large_family_costs_no_row_a_lookup(spark, monkeypatch):
    from shatterlens.scratch import Scratch

    saved, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, label="t": saved.setdefault(label, save(self, df, label)))
    rows = programs(3, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_duplicates(df, "cid", "code", F.col("family"), local_rows=5, bucket_rows=30)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    counted = {k: v for k, v in saved.items() if k not in ("big", "links")}
    assert counted and max(v.count() for v in counted.values()) <= 2 * len(rows)
    assert [k for k, v in counted.items() if "items" in v.columns] == ["all"]  # sets are written once
