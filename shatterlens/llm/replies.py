"""Replies that are unusable as answers: empty, truncated, refused, copied, or in another language.

Whole responses, and the sentences that responses say around their programs, are sorted together by
text. What is a prefix of its next neighbour among the sound ones is a (possibly shortened) version
of it: a reply that is one, or whose sentences all are, and that has no program, broke off before
its program. Lengths at which unfinished replies pile up are taken as limits of length. A program
is whole if it parses and ends as a function must; where parsing fails at its end it broke off.
What is left without a program and is said by no sound reply declines. Copies are found in the
prompt, languages by scripts and by shares of function words.
"""

from __future__ import annotations

import ast
import bisect
import builtins
import json
import re
import textwrap
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shatterlens.operators.skew import lookup_join
from shatterlens.scratch import Scratch

EMPTY, TRUNCATED, REFUSAL, COPY, LANGUAGE = "empty", "truncated", "refusal", "copy", "language"
#: A length is a limit if it has this share of all unfinished replies, two of them at least, and so many times as many as the lengths near it on average.
SPIKE_SHARE, SPIKE_RATIO, SPIKE_REACH = 0.02, 8, 20
#: Share of a reply without a program that must come from the prompt for a copy.
COPY_SHARE = 0.8
#: A text of at least so many words in which the likeliest language has a smaller share of function words (of two letters or more) is in another one.
KNOWN_WORDS, KNOWN_SHARE = 8, 0.085

# Frequent function words by language.
STOP_WORDS = {
    "en": "the a an of and to is it this that with for on in not was are be by from as at my will only no than its so if per",
    "de": "der die das und ich ist ein eine einen dem den des mit für auf von wird werden nur bei sich nicht auch zu im zum zur bleibt nun jetzt pro unten habe sollte nach damit",
    "fr": "le la les un une des du de et est que qui ne pas au aux pour dans sur ce cette il j'ai voici reste même par se plus",
    "es": "el la los las un una de del y que en con no por para se es al lo su más queda he sólo solo está esta este",
    "pt": "o a os as um uma de do da dos das e que para com não por no na em se foi é são ao pelo pela apenas continuam segue",
    "it": "il lo la gli le un una di del della e che non per con da in si è sono ho solo questo questa al",
    "nl": "de het een en van is dat niet voor met op zijn te in er aan dit die alleen",
}
_FENCE = re.compile(r"```[^\n\r`]*(?:\r\n|\r|\n|\Z)(.*?)(?:```|\Z)", re.S)
_MARK = re.compile(r"```[\w+#.-]*")
_BLANK_FENCE = re.compile(r"```[ \t]*[\w+#.-]*")
_SAID = re.compile(r"[^\W_]")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+")
_CODE_START = re.compile(r"^[ \t>]*(?:import\s+\w|from\s+\w+\s+import|def\s+\w+\s*\(|@\w|#)", re.M)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_STOPS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
_END = re.compile(r"[.!?。！？…][\"'”’)\]*_`]*\s*$")
_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(", re.M)
_TOP_DEF = re.compile(r"^(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(", re.M)
_PROGRAM_START = re.compile(r"^[ \t>]*(?:import[ \t]+\w|from[ \t]+[\w.]+[ \t]+import\b|(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(|@\w)", re.M)
_BODY = re.compile(r"\n([ \t]+)(?=[^\s#])")
_IMPORTED = re.compile(r"^[ \t]*(?:import|from)\b.*?(\w+)[ \t]*$", re.M)
_BUILTINS = frozenset(dir(builtins))


def squash(text: str) -> str:
    """A text without spaces and quote marks."""
    return "".join(text.replace(">", " ").split())


def statements(program: str) -> str:
    """A program without spacing and comments."""
    return "".join(re.sub(r"#.*", "", program.replace("\r", "\n")).split())


def languages(text: str) -> set[str]:
    """The likeliest languages of a text; several if it cannot be told, ``other`` for unknown ones, none without words."""
    scripts = {"zh": r"[㐀-鿿]", "ja": r"[぀-ヿ]", "ko": r"[가-힯]", "ru": r"[Ѐ-ӿ]", "el": r"[Ͱ-Ͽ]", "ar": r"[؀-ۿ]"}
    latin = len(re.findall(r"[a-zA-ZÀ-ÿ]", text))
    for name, pattern in scripts.items():
        n = len(re.findall(pattern, text))
        if n >= 2 and n * (3 if name in ("zh", "ja", "ko") else 1) > latin:
            return {"ja"} if name == "zh" and re.search(scripts["ja"], text) else {name}
    words = [w.lower() for w in _WORD.findall(text)]
    score = {k: sum(map(stops.__contains__, words)) for k, stops in _STOPS.items()}
    best = max(score.values())
    if len(words) >= KNOWN_WORDS and max(sum(len(w) > 1 and w in _STOPS[k] for w in words) for k, n in score.items() if n == best) < KNOWN_SHARE * len(words):
        return {"other"}
    return {k for k, n in score.items() if n == best} if best else set()


def _ends(body: list[ast.stmt]) -> ast.Return | bool:
    """Whether control never runs past a block's end: its last return, or True for what raises or branches."""
    last = body[-1]
    if isinstance(last, ast.Return):
        return last
    if isinstance(last, ast.Raise):
        return True
    if isinstance(last, ast.If):
        return bool(last.orelse) and bool(_ends(last.body)) and bool(_ends(last.orelse))
    if isinstance(last, (ast.With, ast.AsyncWith)):
        return _ends(last.body)
    if isinstance(last, (ast.Try, ast.TryStar)):
        if last.finalbody and _ends(last.finalbody):
            return True
        return bool(_ends(last.orelse or last.body)) and all(_ends(h.body) for h in last.handlers)
    if isinstance(last, ast.Match):
        return all(_ends(c.body) for c in last.cases) and any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None for c in last.cases)
    if isinstance(last, ast.While):
        return isinstance(last.test, ast.Constant) and bool(last.test.value) and not any(isinstance(x, ast.Break) for x in ast.walk(last))
    return False


def _bound(tree: ast.AST) -> tuple[set[str], set[str]]:
    """Names that a program gives values to, and names that it imports."""
    own, modules = set(), set()
    for x in ast.walk(tree):
        if isinstance(x, ast.Name):
            if not isinstance(x.ctx, ast.Load):
                own.add(x.id)
        elif isinstance(x, ast.arg):
            own.add(x.arg)
        elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            own.add(x.name)
        elif isinstance(x, ast.alias):
            modules.add((x.asname or x.name).partition(".")[0])
        elif isinstance(x, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and x.name:
            own.add(x.name)
    return own, modules


def _broken_last(program: str, error: SyntaxError) -> bool:
    """Whether a program that does not parse broke off: the fault is at its end, or something was never closed."""
    lines = [x for x in program.splitlines() if x.strip()]
    if not lines or "never closed" in error.msg or "unterminated" in error.msg:
        return True
    end = len(program.rstrip().splitlines())
    if (error.lineno or end) >= end:
        return True
    body = len(lines[-1]) - len(lines[-1].lstrip())  # a fault elsewhere: does the last line return from a function?
    first = next((i for i, x in enumerate(lines) if _TOP_DEF.match(x)), None)
    return first is None or first + 1 >= len(lines) or not lines[-1].lstrip().startswith("return ") or body != len(lines[first + 1]) - len(lines[first + 1].lstrip())


def _plainly_ends(program: str, name: str | None) -> bool:
    """Whether the last line returns, from the body of the last function on top, something whose names stand before it; the usual case, without parsing the rest."""
    tops = list(_TOP_DEF.finditer(program))
    if not tops or name not in (None, tops[-1][1]):
        return False
    text = program.rstrip()
    at = text.rfind("\n") + 1
    line = text[at:]
    first = _BODY.search(text, tops[-1].end())
    if not first or first.start() >= at or line[: len(first[1])] != first[1] or not line[len(first[1]) :].startswith("return ") or text.count('"""') % 2 or text.count("'''") % 2:
        return False
    try:
        value = ast.parse(line.strip()[7:], mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    if isinstance(value, (ast.Name, ast.Attribute)) and ast.unparse(value).partition(".")[0] in _BUILTINS | set(_IMPORTED.findall(program)):
        return False
    names = {x.id for x in ast.walk(value) if isinstance(x, ast.Name)} - _BUILTINS
    return all(re.search(rf"\b{n}\b", text[:at]) for n in names)


def is_complete(program: str, name: str | None = None) -> bool:
    """Whether a program's function ``name`` (or else its last one) is there to its last statement, which returns something that the program has."""
    program = textwrap.dedent(program.replace("\r\n", "\n").replace("\r", "\n"))
    if _plainly_ends(program, name):
        return True
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(program)
    except SyntaxError as e:
        return not _broken_last(program, e) and (name is None or name in _TOP_DEF.findall(program))
    except (ValueError, RecursionError, MemoryError):
        return False
    functions = [x for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and name in (None, x.name)]
    if not functions:
        return False
    last = _ends(functions[-1].body)
    if not isinstance(last, ast.Return):
        return bool(last)
    if last.value is None:
        return False
    own, modules = _bound(tree)
    value = last.value
    while isinstance(value, ast.Attribute):
        value = value.value
    if isinstance(value, ast.Name) and value.id not in own and (value.id in modules or value.id in _BUILTINS):
        return False  # the start of a call
    used = {x.id for x in ast.walk(last.value) if isinstance(x, ast.Name)}
    return used <= own | modules | _BUILTINS


def _programs(reply: str, code: str | None = None) -> list[str]:
    """The programs of a reply: its fenced blocks with a function, else what was taken from it, else its lines of code."""
    plain = re.sub(r"^[ \t]*> ?", "", reply, flags=re.M) if len(re.findall(r"^[ \t]*>", reply, re.M)) > 2 else reply
    blocks = [b for b in _FENCE.findall(plain) if _DEF.search(b)] if "```" in plain else []
    if not blocks and _DEF.search(plain):
        blocks = [_trimmed(plain)]
    if blocks and code and _DEF.search(code) and code not in blocks and code in reply:
        blocks.append(code)
    return blocks


def _outside(reply: str) -> str:
    """What a reply says outside its program."""
    if "```" in reply:
        return _FENCE.sub("\n", reply)
    start = _CODE_START.search(reply)
    if not start:
        return reply
    after, inside = [], True
    for line in reply[start.start() :].splitlines():
        inside = inside and (not line.strip() or line[0] in " \t>#@)]}" or bool(_CODE_START.match(line)))
        if not inside:
            after.append(line)
    return reply[: start.start()] + "\n" + "\n".join(after)


def sentences(text: str) -> list[str]:
    """Sentences with numbers masked and spaces evened; a cut one keeps no end mark."""
    parts = (re.sub(r"\s+", " ", s).strip(" \t*_>-") for s in _SENTENCE.split(_NUMBER.sub("#", text)))
    return [s for s in parts if _SAID.search(s)]


def prompt_of(messages: str | None) -> str:
    """The last message's text; '' for what is no list of messages."""
    try:
        last = json.loads(messages or "")[-1]["content"]
    except (ValueError, LookupError, TypeError):
        return ""
    return last if isinstance(last, str) else ""


def judge(messages: str | None, reply: str | None, code: str | None = None) -> tuple[str | None, list[str], bool]:
    """(defect, 'open' if the corpus must decide, or None), sentences around the program, whether it has one.

    The function that a program must define is the last one of the prompt's last program.
    """
    if not _SAID.search(_BLANK_FENCE.sub("", reply or "")):
        return EMPTY, [], False
    core = _MARK.sub("", reply)
    prompt = prompt_of(messages)
    parents = [b for b in _FENCE.findall(prompt) if _DEF.search(b)]
    parent = parents[-1] if parents else ""
    programs, known, said = _programs(reply, code), squash(_MARK.sub("", prompt)), squash(core)
    if said in known:
        own = squash(parent)
        broken_off = own.startswith(said) and said != own and _CODE_START.match(core.lstrip())
        return (TRUNCATED if broken_off else COPY), [], False
    outside = _outside(reply)
    if programs:
        around = sentences(outside)
        wanted = _TOP_DEF.findall(textwrap.dedent(parent))[-1:] or [None]
        whole = [p for p in programs if is_complete(p, wanted[0])]
        same = statements(parent)
        if not whole:
            whole_parent = parent and squash(parent) in said
            return (COPY if whole_parent else TRUNCATED), around, True
        if same and any(statements(p) == same for p in map(_trimmed, whole)) and all(same in statements(p) or statements(p) in same for p in whole):
            return COPY, around, True
        theirs, asked = languages(outside), languages(_FENCE.sub(" ", prompt))
        if theirs and asked and not theirs & asked:
            return LANGUAGE, around, True
        return None, around, True
    if _PROGRAM_START.search(reply):
        return TRUNCATED, [], False
    own = sentences(_MARK.sub("", reply))
    pieces = [squash(s) for s in _SENTENCE.split(core) if _SAID.search(s)]
    pieces = [p for p in pieces if len(p) > 7] or pieces
    if known and sum(len(p) for p in pieces if p in known) >= COPY_SHARE * sum(map(len, pieces)):
        return COPY, [], False
    return "open", own, False


def _trimmed(program: str) -> str:
    """A program from its first line of code on, up to what is no longer code."""
    start = _CODE_START.search(program)
    lines = []
    for line in program[start.start() if start else 0 :].splitlines():
        if line.strip() and line[0] not in " \t>#@)]}" and not _CODE_START.match(line):
            break
        lines.append(line)
    return "\n".join(lines)


def whole_of(reply: str) -> str:
    """A whole response with numbers masked and spaces evened, without fence marks at its end."""
    return re.sub(r"\s+", " ", _NUMBER.sub("#", _MARK.sub("", reply))).strip()


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, messages, reply, code in zip(pdf["id"], pdf["messages"], pdf["reply"], pdf["code"]):
            defect, around, has_program = judge(messages, reply, code)
            whole = whole_of(reply) if has_program or defect == "open" else None
            rows.append((key, defect, around, whole, has_program, len(reply or ""), not _END.search(reply or "")))
        yield pd.DataFrame(rows, columns=["id", "defect", "around", "whole", "has_program", "length", "cut"])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts in ascending order: is each a prefix of a known one? What starts with a text follows it without a gap.

    Only texts that are prefixes of the present one are held. Those open at the end of the
    partition have NULL; the partition's first known text comes with ``edge``.
    """
    held: list[str] = []
    edge = pid = None
    for pdf in batches:
        out: list[tuple] = []
        for s, known, asked, pid in zip(*(pdf[c].tolist() for c in ("s", "known", "asked", "pid"))):
            while held and not s.startswith(held[-1]):
                out.append((held.pop(), False, pid, False))
            if known:
                if edge is None:
                    edge = s
                    out.append((s, None, pid, True))
                out += [(h, True, pid, False) for h in held]
                held.clear()
                if asked:
                    out.append((s, True, pid, False))
            else:
                held.append(s)
        yield pd.DataFrame(out, columns=["s", "short", "pid", "edge"]).astype({"short": object})
    if held:
        yield pd.DataFrame([(h, None, pid, False) for h in held], columns=["s", "short", "pid", "edge"]).astype({"short": object})


def _shortened(scratch: Scratch, known: DataFrame, asked: DataFrame) -> DataFrame:
    """(s, short): whether each asked text is a prefix of a known one."""
    both = known.select("s", F.lit(True).alias("known")).unionByName(asked.select("s", F.lit(False).alias("known"))).groupBy("s").agg(F.max("known").alias("known"), F.bool_or(~F.col("known")).alias("asked"))
    ordered = both.repartitionByRange("s").sortWithinPartitions("s").withColumn("pid", F.spark_partition_id())
    seen = ordered.mapInPandas(_scan, "s string, short boolean, pid int, edge boolean")
    seen = scratch.save(seen, "neighbours")
    firsts = sorted((r.pid, r.s) for r in seen.where("edge").select("pid", "s").collect())  # one a partition
    pids = [p for p, _ in firsts]

    def over_the_edge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            short = []
            for s, pid in zip(pdf["s"], pdf["pid"]):
                at = bisect.bisect_right(pids, pid)
                short.append(at < len(firsts) and firsts[at][1].startswith(s))
            yield pdf[["s"]].assign(short=short)

    rows = seen.where(~F.col("edge"))
    late = rows.where(F.col("short").isNull()).select("s", "pid").mapInPandas(over_the_edge, "s string, short boolean")
    return rows.where(F.col("short").isNotNull()).select("s", "short").unionByName(late)


def length_limits(lengths: DataFrame) -> DataFrame:
    """(length) of the spikes in a table of the lengths of unfinished replies; the same for a table that repeats all rows."""
    counts = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    reach = F.explode(F.sequence(F.lit(-SPIKE_REACH), F.lit(SPIKE_REACH)))
    near = counts.select(reach.alias("d"), "length", "n").where(F.col("d") != 0).groupBy((F.col("length") + F.col("d")).alias("length")).agg((F.sum("n") / (2 * SPIKE_REACH)).alias("usual"))
    total = counts.agg(F.sum("n").alias("total"))
    high = counts.join(near, "length", "left").join(F.broadcast(total))  # one row
    least = F.greatest(F.lit(2.0), SPIKE_SHARE * F.col("total"))
    return high.where((F.col("n") >= least) & (F.col("n") >= SPIKE_RATIO * F.coalesce("usual", F.lit(0.0)))).select("length")


def defective_replies(calls: DataFrame, id_column: str = "prompt_id", messages_column: str = "messages", reply_column: str = "raw_response", code_column: str = "code") -> DataFrame:
    """(prompt_id, defect), one row per defective prompt; the first that holds of the module's rules.

    empty: NULL, or no letter or digit apart from fence marks. copy: all of it stands in the prompt
    (spacing and quote marks aside), or its only complete program is the parent with no
    statement changed. truncated: a program that has begun but not ended, or a reply without one that is a prefix of a
    sound reply, or made of its sentences, or in part and without an end mark or as long as a limit. refusal: neither,
    without a program. language: a complete program among sentences of another language than the prompt's. A program that
    was taken from the reply (``code_column``, where there is one) counts as a program of the reply. Messages that cannot be read give
    an empty prompt, so that copy and language do not apply. Repeated rows count once; of rows that differ each has its say and the
    least defect by name counts. A NULL id is an id. An empty table gives no rows.
    """
    scratch = Scratch(calls.sparkSession)
    taken = F.col(code_column) if code_column in calls.columns else F.lit(None).cast("string")
    slim = calls.select(F.col(id_column).cast("string").alias("id"), F.col(messages_column).alias("messages"), F.col(reply_column).alias("reply"), taken.alias("code"))
    schema = "id string, defect string, around array<string>, whole string, has_program boolean, length int, cut boolean"
    judged = scratch.save(slim.mapInPandas(_judged, schema), "judged")
    open_ = scratch.save(judged.where(F.col("defect") == "open").select("id", "around", "whole", "length", "cut").distinct(), "open")
    decided = judged.where(F.col("defect").isNotNull() & (F.col("defect") != "open")).select("id", "defect")
    sound = F.col("has_program") & (F.col("defect").isNull() | (F.col("defect") == LANGUAGE))
    known = judged.where("has_program").select(F.explode("around").alias("s")).distinct().unionByName(judged.where(sound).select(F.col("whole").alias("s")))
    told = open_.select("id", "whole", "length", "cut", F.explode("around").alias("s"))
    short = scratch.save(_shortened(scratch, known, told.select("s").unionByName(open_.select(F.col("whole").alias("s"))).distinct()), "short")
    told = lookup_join(told, short, ["s"], told.count())
    limits = length_limits(judged.where(~F.col("has_program") & (F.col("length") > 0) | (F.col("defect") == TRUNCATED)).select("length"))
    by_reply = told.groupBy("id", "whole", "length", "cut").agg(F.bool_and("short").alias("all_short"), F.avg(F.col("short").cast("double")).alias("share"))
    by_reply = lookup_join(by_reply, short.select(F.col("s").alias("whole"), F.col("short").alias("whole_short")), ["whole"], open_.count())
    by_reply = by_reply.join(F.broadcast(limits.withColumn("limit", F.lit(True))), "length", "left")  # at most 1 / SPIKE_SHARE of them
    partly = (F.col("share") > 0) & (F.col("cut") | F.coalesce("limit", F.lit(False)))
    verdict: Column = F.when(F.col("whole_short") | F.col("all_short") | (F.col("share") >= 0.5) | partly, TRUNCATED).otherwise(REFUSAL)
    found = decided.unionByName(by_reply.select("id", verdict.alias("defect")))
    return found.groupBy("id").agg(F.min("defect").alias("defect")).withColumnRenamed("id", id_column)
