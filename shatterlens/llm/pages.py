"""Pages of stuffed keywords, links, tags, product labels or menu paths instead of sentences.

Every line of a page is reduced to its shape: how many links, how its words spread over fields
between separators, how many of them are capitals or numbers, how it ends. No list of words of any
language takes part. Some shapes are lists by themselves (links with short labels, tags, menu
paths, many short fields). Phrases and runs of words are lists if the page repeats them: keywords
come again within a line, or in new combinations, where sentences have new words or come again
whole. A page is flagged if list lines hold more than half of its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Share of a page's characters beyond which it counts.
SHARE = 0.5
#: Words of a block that is judged as one, and the least share of its words that must be repeated.
BLOCK_WORDS, REPEATED = 50, 0.3
#: A shorter block repeats nothing; weight of a block's share beside that of a piece of it.
LEAST_WORDS, SMOOTHING = 8, 8
#: A block in which at most this share of words can be covered has no list.
FEW_REPEATED = 0.2
#: A list of phrases has at least so many lines, and at most this share of its words are different ones.
PHRASE_LINES, PHRASE_VARIETY = 4, 0.45
#: Words up to this length also repeat within good sentences.
SHORT = 3
#: Greatest number of words in a phrase, and of words to a link.
PHRASE_WORDS, LABEL_WORDS = 5, 8
#: Fields of a list line, and the greatest number of words to a field.
FIELDS, FIELD_WORDS = 4, 4

_URL = re.compile(
    r"\bh(?:tt|xx)ps?://[^\s<>\"')\]|]+(?:\[\.\][^\s<>\"')\]|]+)*|\bwww(?:\.|\[\.\])[^\s<>\"')\]|]+(?:\[\.\][^\s<>\"')\]|]+)*"
    r"|(?<![\w.@/\]-])[a-z0-9-]++(?:(?:\.|\[\.\])[a-z0-9-]++){0,8}?(?:\.|\[\.\])[a-z][a-z-]+/[^\s<>\"')\]|]*",
    re.I,
)
_TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
_WORD = re.compile(r"\b[^\W\d_]+(?:['’-][^\W\d_]+)*\b")
_PART = re.compile(r"[^\W\d_]+")
_INITIAL = re.compile(r"\b[A-Z]\.[ ,]")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+")
_STAMP = re.compile(r"\W{0,2}\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\W{0,2}\d\d:\d\d:\d\d")
_SETTING = re.compile(r"[\w.\-]+\s*[:=]\s*\S*(?:\s+\S+){0,2}$")
_HASH = re.compile(r"(?:[#@][\w\-]+[\s,;|/·]*)+$")
_BRACKETS = re.compile(r"(?:\[[^\][()={}\d][^\][()={}]*\][\s,;|/·-]*)+$")
_MENU = re.compile(r"\s*(?:>{1,2}|›|»|→|::|&gt;)\s*")
_STEP = re.compile(r"[>›»→]|::|&gt;")
_FIELDS = re.compile(r"\s*[,;|\t、，；｜·•/]\s*|\s+[-–—~]\s+")
_WIDE = re.compile(r"([^\S\t])[^\S\t]+|(\t)\t+")
_BULLET = re.compile(r"^\s*(?:[-*+•·]|\d{1,3}[.)])\s+")
_NUMBER = re.compile(r"[+-]?\d[\d.,:%]*$|(?:null|none|true|false|nan|n/a|-)$", re.I)
_CODE = re.compile(r"[={}\\]|\w\(|\w\[|\)\s*:?$|:\s*$|^\s*(?:#\s|\"\"\"|@\w)|\"\"\"")
_STOP = re.compile(r"[.!?。！？…:](?:[\"'”’)\]]*)(?:\s|$)|[。！？]")
_WIDE_STOP = re.compile(r"(?<=[。！？])")
#: Lines of such characters only have no links, tags, marks of code or wide letters.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9 .!?'’,-]*+")
_LINKED = re.compile(r"://|www[.\[]|\[\.\]|<a |\w/", re.I)

DATA, LIST, PHRASE, WORDS, SENTENCE, BLANK = range(6)


def pieces_of(line: str) -> list[str]:
    """A line cut at the ends of its sentences; the dot of an initial ends none."""
    if len(line) <= 40:
        return [line]
    parts = line.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")
    out = parts[:1]
    for p in parts[1:]:
        if out[-1][-2:-1].isupper() and out[-1][-1] == ".":
            out[-1] += " " + p
        else:
            out.append(p)
    if "。" in line or "！" in line or "？" in line:
        out = [q for p in out for q in _WIDE_STOP.split(p) if q]
    return out


def _plain_kind(text: str) -> int:
    """Kind of a piece without links, tags or marks of data."""
    fields = [f for f in _FIELDS.split(text) if f]
    numbers = sum(bool(_NUMBER.match(f)) for f in fields)
    if len(fields) > 1 and numbers * 4 >= len(fields):
        return DATA
    wide = sum(map(len, _CJK.findall(text)))
    n = len(_WORD.findall(text))
    if not n:
        return DATA
    end = text.rstrip()[-1]
    if wide and end in "。！？":
        return SENTENCE
    if wide * 2 > len(text.replace(" ", "")):
        runs = sum(len(f.split()) for f in fields)
        if runs >= FIELDS and wide <= 9 * runs and not _STOP.search(text):
            return LIST
        return PHRASE if wide <= 12 and not _STOP.search(text) else SENTENCE
    if _INITIAL.search(text):
        return WORDS  # authors
    if len(fields) >= FIELDS and n <= FIELD_WORDS * len(fields) and (end not in ".!?。！？…" or len(fields) >= 3 * FIELDS):
        return LIST
    return PHRASE if n <= PHRASE_WORDS and not _STOP.search(text) else WORDS


def line_kind(line: str) -> int:
    """DATA, LIST, PHRASE (a few words), WORDS (a sentence or a run of words), SENTENCE (of wide letters) or BLANK."""
    text = line.strip()
    if not text:
        return BLANK
    if len(text) > 1000:  # long gaps would be scanned again and again
        text = _WIDE.sub(r"\1\2", text)
    if _STAMP.match(text):
        return DATA
    bare = _BULLET.sub("", text)
    if _LINKED.search(bare):
        links = len(_URL.findall(bare))
        if links or "<a " in bare:
            rest = len(_WORD.findall(_TAG.sub(" ", _URL.sub(" ", bare))))
            return LIST if rest <= LABEL_WORDS * max(1, links) else WORDS
    if bare[0] in "#@[":
        if _HASH.match(bare) and not text.startswith("# ") or _BRACKETS.match(bare):
            return LIST
    steps = _MENU.split(bare) if _STEP.search(bare) else ()
    if len(steps) >= 3 and all(0 < len(s.split()) <= 5 for s in steps) and not _CODE.search(bare):
        return LIST
    if _CODE.search(text):
        return DATA
    if _SETTING.match(bare) and bare.count(",") < 2:
        return DATA
    return _plain_kind(bare)


def line_shape(line: str, kind: int) -> tuple[int, int, int, int, str]:
    """Kind, links, words and capitals (by powers of two), and the commonest separator of a line."""
    words = _WORD.findall(line)
    marks = Counter(c for c in line if c in ",;|/>#[、，；｜·•-")
    capitals = sum(w[0].isupper() for w in words)
    return kind, len(_URL.findall(line)).bit_length(), len(words).bit_length(), capitals.bit_length(), max(marks, key=marks.__getitem__) if marks else " "


def repeated_shares(pieces: list[list[str]]) -> list[float]:
    """Share of each piece's words that are keywords come again: longer words twice in a piece, or pairs of words that recur between other words.

    A sentence made by the same pattern as another one has the same words on at least one side of its pairs. Short
    pieces are drawn towards the share of all: that counts as so many words as SMOOTHING.
    """
    words = [w for p in pieces for w in p]
    if len(words) < LEAST_WORDS:
        return [0.0] * len(pieces)
    pairs = [q for p in pieces for q in zip(p, p[1:])]
    again = 4 * (len(pairs) - len(set(pairs)))
    for p in pieces:
        longer = [w for w in p if len(w) > SHORT]
        again += 2 * (len(longer) - len(set(longer)))
    if again < FEW_REPEATED * len(words):  # more words than these cannot be covered
        return [0.0] * len(pieces)
    covered = bytearray(len(words))
    seen: dict[tuple[str, str], tuple[int, str, str]] = {}
    at = 0
    for p in pieces:
        first: dict[str, int] = {}
        before = ""
        for i, w in enumerate(p):
            k = at + i
            if len(w) > SHORT:
                if w in first:
                    covered[k] = covered[first[w]] = 1
                else:
                    first[w] = k
            if i + 1 < len(p):
                after = p[i + 2] if i + 2 < len(p) else ""
                last = seen.get((w, p[i + 1]))
                if last and last[1] != before and last[2] != after:
                    j = last[0]
                    covered[k] = covered[k + 1] = covered[j] = covered[j + 1] = 1
                seen[w, p[i + 1]] = (k, before, after)
            before = w
        at += len(p)
    usual = sum(covered) / len(words)
    out, at = [], 0
    for p in pieces:
        out.append((sum(covered[at : at + len(p)]) + SMOOTHING * usual) / (len(p) + SMOOTHING))
        at += len(p)
    return out


def list_share(text: str | None, few: int | None = None, least: float | None = None) -> float:
    """Share of a page's characters (line breaks aside) in lines of list shapes, all or the ``few`` commonest ones.

    Lines are cut at sentence ends first, as lists can follow a sentence on its line. A run of words that comes
    again whole is judged with its first place, or is a list if it has no end mark and comes four times. With
    ``least`` a page is given up, with share 0, as soon as more than 1 - ``least`` of it is surely no list.
    """
    if not text:
        return 0.0
    lines = text.splitlines()
    total = sum(map(len, lines))
    enough = total + 1 if least is None else (1 - least) * total
    groups: Counter = Counter()
    phrases: list[str] = []
    verdict: dict[str, list] = {}  # run of words: characters, times, whether it is a list (None: open)
    block: list[list[str]] = []
    held: list[str] = []
    size = sure = 0

    def close() -> None:
        nonlocal size, sure
        for piece, share in zip(held, repeated_shares(block)):
            entry = verdict[piece]
            entry[2] = share >= REPEATED
            if not entry[2] and piece[-1] in ".!?":
                sure += entry[0]
        block.clear()
        held.clear()
        size = 0

    def words_of(piece: str, words: list[str]) -> None:
        nonlocal size, sure
        known = verdict.get(piece)
        if known:
            known[0] += len(piece)
            known[1] += 1
            if known[2] is False and piece[-1] in ".!?":
                sure += len(piece)
            return
        verdict[piece] = [len(piece), 1, None]
        block.append(words)
        held.append(piece)
        size += len(words)
        if size > BLOCK_WORDS:
            close()

    fenced = False
    for line in lines:
        if not line:
            continue
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if size > BLOCK_WORDS // 2:
            close()
        if sure > enough:
            return 0.0
        plain = _PLAIN.fullmatch(line)
        for piece in pieces_of(line):
            if plain and piece.count(",") < FIELDS - 1 and " - " not in piece:
                words = _PART.findall(piece.lower())
                if len(words) > PHRASE_WORDS:
                    words_of(piece, words)
                    continue
            kind = line_kind(piece)
            if kind == LIST:
                groups[line_shape(piece, kind)] += len(piece)
            elif kind == WORDS:
                words_of(piece, _PART.findall(piece.lower()))
            elif kind == PHRASE and not fenced:
                phrases.append(piece)
            else:
                sure += len(piece)
    close()
    for piece, (chars, times, yes) in verdict.items():
        if yes or times >= PHRASE_LINES and not _STOP.search(piece):
            groups[line_shape(piece, WORDS)] += chars
    words = [w for p in phrases for w in _PART.findall(p.lower())] if len(phrases) >= PHRASE_LINES else []
    if words and len(set(words)) <= PHRASE_VARIETY * len(words):
        for piece in phrases:
            groups[line_shape(piece, PHRASE)] += len(piece)
    return sum(n for _, n in groups.most_common(few)) / total if total else 0.0


def list_pages(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float = SHARE) -> DataFrame:
    """(id, list_share) of the pages whose share of list lines is above ``share``.

    One pass without a shuffle. NULL, empty and blank texts and texts without words have share 0. Repeated rows come out repeatedly.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pdf["text"].map(lambda t: list_share(t, least=share))
            yield pd.DataFrame({"id": pdf["id"], "list_share": found})[found > share]

    slim = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInPandas(kernel, f"id {kind}, list_share double").withColumnRenamed("id", id_column)
