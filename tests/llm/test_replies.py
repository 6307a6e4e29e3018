import json

import pytest

from shatterlens.llm import replies
from shatterlens.llm.replies import defective_replies, is_complete, judge, languages

PARENT = """import heapq


def degree_order(G):
    adj = {u: set(G[u]) for u in G}
    out = []
    # late phase
    for u in sorted(adj, key=lambda q: -len(adj[q])):
        out.append(u)
    return list(dict.fromkeys(out))"""
CHILD = PARENT.replace("-len(adj[q])", "-2.5 * len(adj[q])")
PROMPT = f"Write one mutation of the parent program. The result must list every node once.\n\nParent:\n```python\n{PARENT}\n```\n\nReturn only the new program."
SAID = "The program below caps the sample so that hubs stay cheap. I kept the tie rule and replaced one term."
MESSAGES = json.dumps([{"role": "system", "content": "You design."}, {"role": "user", "content": PROMPT}])


def fenced(code, said=SAID + "\n\n", tail="\n```"):
    return f"{said}```python\n{code}{tail}"


CASES = {
    "null": (None, "empty"), "blank": (" \u200b\n", "empty"), "dots": ("...", "empty"), "fence": ("```python\n\n```", "empty"), "open fence": ("``` python\n", "empty"),
    "sound": (fenced(CHILD), None), "bare code": (CHILD, None), "open fence of a whole program": (fenced(CHILD, tail=""), None), "crlf": (fenced(CHILD).replace("\n", "\r\n"), None),
    "decoy": (fenced(CHILD, "I cannot run the program here, so the change is untested.\n"), None),
    "cut in code": (fenced(CHILD[:150], tail=""), "truncated"), "cut, fence closed": (fenced(CHILD[:-30]), "truncated"), "cut in the last return": (CHILD[:-8], "truncated"),
    "cut at an early place": (PARENT[:60], "truncated"), "cut before any program": (SAID[:70], "truncated"),
    "refusal": ("I must decline. Please consult a specialist instead.", "refusal"), "german refusal": ("Es tut mir leid, dabei kann ich nicht helfen.", "refusal"),
    "fenced refusal": ("```\nNo program can be supplied for this request.\n```", "refusal"), "unheard refusal": ("That path stays closed to me.", "refusal"),
    "whole prompt": (PROMPT, "copy"), "quoted prompt": ("\n".join("> " + x for x in PROMPT.splitlines()), "copy"), "one line": (" ".join(PROMPT.split()), "copy"),
    "passage": ("The result must list every node once.", "copy"), "parent again": (fenced(PARENT), "copy"),
    "parent, comments and spacing": (fenced(PARENT.replace("    # late phase\n", "# cheap\n\n").replace("    ", "  ")), "copy"),
    "language": (fenced(CHILD, "El bucle principal queda igual y la regla de empate no cambia.\n"), "language"), "chinese": (fenced(CHILD, "主循环保持不变，仅替换了一个局部得分项。\n"), "language"),
}


def test_all_kinds(spark):
    rows = [(k, MESSAGES, v[0], "x") for k, v in CASES.items()]
    rows += [("sound 2", MESSAGES, fenced(CHILD), ""), ("null", MESSAGES, None, ""), ("no prompt", None, fenced(PARENT), ""), ("bad prompt", "{", fenced(CHILD), "")]
    got = defective_replies(spark.createDataFrame(rows, "prompt_id string, messages string, raw_response string, defect string")).collect()
    assert {r.prompt_id: r.defect for r in got} == {k: v[1] for k, v in CASES.items() if v[1]}
    assert len(got) == len({r.prompt_id for r in got})


def test_empty_table(spark):
    assert defective_replies(spark.createDataFrame([], "prompt_id string, messages string, raw_response string")).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_prefixes_across_partitions(spark, parts):
    from shatterlens.scratch import Scratch

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        known = spark.createDataFrame([(f"k{i:03d} and more",) for i in range(200)], "s string")
        asked = spark.createDataFrame([(f"k{i:03d}",) for i in range(0, 200, 7)] + [("k005 and more",), ("k0055",), ("zz",), ("",)], "s string")
        got = {r.s: r.short for r in replies._shortened(Scratch(spark), known, asked).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert all(got[f"k{i:03d}"] for i in range(0, 200, 7)) and got["k005 and more"] and got[""]
    assert not got["k0055"] and not got["zz"]


def test_length_limits(spark):
    rows = [(n,) for n in range(100, 200)] + [(150,)] * 60
    assert [r.length for r in replies.length_limits(spark.createDataFrame(rows, "length int")).collect()] == [150]


def test_parts():
    assert is_complete(PARENT) and not is_complete(PARENT[:-2]) and not is_complete("x = 1")
    assert languages("a") == {"en", "pt"} and languages("") == set()
    assert judge(MESSAGES, "y" * 200_000)[0] == "open"


@pytest.mark.parametrize("part", ["a", " ", "\n", "```", "``` ", "```\n", "> ", "def degree_order(G):\n", "return ", "    return x\n", "#", "# a\n", ".", ". ", "1.", "(", "no ", "import x\n", "。", "\\t", "def degree_order(G): "])
def test_very_long_replies(part):
    import time

    began = time.perf_counter()
    for reply in (part * 100_000, "x" + part * 100_000 + "y", fenced(CHILD, part * 50_000 + "\n")):
        judge(MESSAGES, reply)
        judge(json.dumps([{"role": "user", "content": reply}]), reply[: len(reply) // 2])
    assert time.perf_counter() - began < 20


HEAD = "def place(G):\n    out = []\n    for u in G:\n        out.append(u)\n"
ENDS = {
    "if and else": "    if out:\n        return out\n    else:\n        return []",
    "try": "    try:\n        return sorted(out)\n    except TypeError:\n        return out",
    "many lines": "    return list(\n        dict.fromkeys(out)\n    )",
    "unpacked": "    best, rest = out[:1], out[1:]\n    return rest",
    "with": "    with G.lock() as held:\n        kept = [x for x in out if x in held]\n    return kept",
    "within with": "    with G.lock():\n        return out",
    "loop": "    while True:\n        if not out:\n            return out\n        out.pop()",
    "raises": "    if out:\n        return out\n    raise ValueError(out)",
    "match": "    match out:\n        case []:\n            return []\n        case _:\n            return out",
    "comment after": "    return out\n    # the end",
    "helper after": "    return rest(out)\n\n\ndef rest(x):\n    return x",
    "fault elsewhere": "    print 'x'\n    return out",
}


@pytest.mark.parametrize("name", ENDS)
def test_whole_programs_of_many_shapes(name):
    assert is_complete(HEAD + ENDS[name]), name
    assert is_complete((HEAD + ENDS[name]).replace("\n", "\r\n"), "place"), name


@pytest.mark.parametrize("tail", ["", "    return", "    return list(\n        dict.from", "    return sorted", "    return ou", "    if out:\n        return out", "    try:\n        return out", "    return out[", "    s = '''x\n    return out"])
def test_programs_that_broke_off(tail):
    assert not is_complete(HEAD + tail), tail
    assert not is_complete(HEAD + "    return out", "other")


@pytest.mark.parametrize("said", ["Niestety nie mogę pomóc w tej sprawie.", "申し訳ありませんが、このご依頼にはお応えできません。", "Jag måste tyvärr säga nej till detta.", "That lies beyond my remit today.", "I must decline"])
def test_refusals_need_no_wording(spark, said):
    rows = [("a", MESSAGES, said), ("b", MESSAGES, fenced(CHILD)), ("c", MESSAGES, fenced(CHILD))]
    got = defective_replies(spark.createDataFrame(rows, "prompt_id string, messages string, raw_response string")).collect()
    assert [(r.prompt_id, r.defect) for r in got] == [("a", "refusal")]


@pytest.mark.parametrize("said", ["Główna pętla pozostaje bez zmian, a remisy nadal rozstrzyga nazwa węzła.", "Huvudslingan är oförändrad och lika värden avgörs fortfarande av nodens namn.", "Pääsilmukka pysyy ennallaan, ja tasatilanteet ratkaisee yhä solmun nimi joka kerta."])
def test_languages_without_a_list(said):
    assert judge(MESSAGES, fenced(CHILD, said + "\n"))[0] == "language"


def test_any_function_name_and_taken_code():
    other = lambda t: t.replace("degree_order", "rank_nodes")
    assert judge(other(MESSAGES), other(fenced(CHILD)))[0] is None
    assert judge(other(MESSAGES), other(fenced(CHILD[:-20])))[0] == "truncated"
    assert judge(MESSAGES, "```\nCHANGED\n```\n" + CHILD, CHILD)[0] is None
    assert judge(MESSAGES, None, CHILD)[0] == "empty"


def test_limits_do_not_depend_on_the_size_of_the_corpus(spark):
    rows = [(n,) for n in range(100, 200)] + [(150,)] * 20
    few = spark.createDataFrame(rows, "length int")
    many = spark.createDataFrame(rows * 10, "length int")
    assert [r.length for r in replies.length_limits(few).collect()] == [r.length for r in replies.length_limits(many).collect()] == [150]


def test_whole_replies_are_compared(spark):
    rows = [("a", MESSAGES, SAID + "\n"), ("b", MESSAGES, fenced(CHILD)), ("c", MESSAGES, SAID[:20])]
    got = defective_replies(spark.createDataFrame(rows, "prompt_id string, messages string, raw_response string")).collect()
    assert {(r.prompt_id, r.defect) for r in got} == {("a", "truncated"), ("c", "truncated")}
