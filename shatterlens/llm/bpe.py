"""Byte-level BPE of a public tokenizer over a whole corpus, in time linear in the text.

The bytes of a piece are read as Latin-1, so that an Aho-Corasick automaton over the vocabulary
finds, for every place, the longest token that starts there. From the left the longest token is
taken; if it cannot stand beside the one before it, its next shorter prefix is tried, and if none
is left the token before is taken back. Two tokens can stand side by side if no merge of lower
rank would have crossed their border; that is found by undoing merges and remembered per pair. A
place that was taken back is never tried again, so the work is linear, and the result is the one
that merging pairs in order of rank gives.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Folder of the public tokenizers' files; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.json"

# Fixed value: how byte-level BPE splits text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same over ASCII only, for the faster of the two regular expression engines, whose \s would also take U+001C to U+001F.
_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+""")
_ANY = regex.compile(PIECES)
#: Pieces kept per Python worker, and the longest one that is kept.
CACHE_PIECES, CACHE_LENGTH = 200_000, 64
#: Pairs of tokens kept per Python worker.
CACHE_PAIRS = 1_000_000


def _byte_of() -> dict[str, int]:
    """Byte of each printable stand-in that vocabulary files of byte-level BPE use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Encoder of a byte-level BPE vocabulary (``tokenizers`` JSON) whose ids rise with merge rank."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        latin = lambda token: "".join(chr(byte[c]) for c in token)
        ids = {latin(t): i for t, i in model["vocab"].items()}
        size = max(ids.values()) + 1
        self.left, self.right = array("l", range(size)), array("l", range(size))
        self.merged: dict[int, int] = {}
        self.length, self.size = array("l", [0] * size), size
        for t, i in ids.items():
            self.length[i] = len(t)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        reached = {i for t, i in ids.items() if len(t) == 1}
        self._pairs: dict[int, bool] = {}
        for a, b in merges:
            x, y = ids[latin(a)], ids[latin(b)]
            z = ids[latin(a) + latin(b)]
            if z <= max(x, y):
                raise ValueError("ids must rise with merge rank")
            self.merged.setdefault(x * size + y, z)
        for a, b in merges:  # tokens that merging can never leave behind take no part
            x, y = ids[latin(a)], ids[latin(b)]
            z = ids[latin(a) + latin(b)]
            if z not in reached and x in reached and y in reached and self._compatible(x, y, z):
                self.left[z], self.right[z] = x, y
                reached.add(z)
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if i in reached:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = array("l", [-1] * size)
        for t, i in ids.items():
            for n in range(len(t) - 1, 0, -1):
                prefix = ids.get(t[:n])
                if prefix in reached:
                    self.shorter[i] = prefix
                    break
        self._cache: dict[str, bytes] = {}

    def _compatible(self, x: int, y: int, limit: int) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the border of x and y while they are built."""
        left, right, merged, size = self.left, self.right, self.merged, self.size
        while True:
            z = merged.get(x * size + y)
            if z is not None and z < limit:
                return False
            # undo the later one of the two merges; the border then lies between its inner part and the other
            if x > y:
                limit, inner = x, right[x]
                if inner != x:
                    x = inner
                    continue
                limit, inner = y + 1, left[y]
                if inner == y:
                    return True
                y = inner
            else:
                limit, inner = y + 1, left[y]
                if inner != y:
                    y = inner
                    continue
                limit, inner = x, right[x]
                if inner == x:
                    return True
                x = inner

    def side_by_side(self, x: int, y: int) -> bool:
        key = x * self.size + y
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._compatible(x, y, 1 << 60)
        return known

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as 32-bit integers."""
        text = piece.encode("utf-8", "replace").decode("latin-1")
        n = len(text)
        longest = array("l", [-1] * n)
        length, shorter = self.length, self.shorter
        for end, token in self.automaton.iter(text):
            longest[end - length[token] + 1] = token  # ends only grow, so the last is the longest
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + length[token]
            if open_[end] and (not out or self.side_by_side(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # nothing fits here: this place is a dead end
                open_[at] = 0
                token = out.pop()
                at -= length[token]
        return np.array(out, dtype="<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers; none for NULL and empty texts."""
        if not text:
            return b""
        cache = self._cache
        pieces = (_ASCII if text.isascii() else _ANY).findall(text)
        try:
            return b"".join(map(cache.__getitem__, pieces))
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = cache.get(p)
            if ids is None:
                ids = self.encode_piece(p)
                if len(p) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)


_loaded: dict[str, ByteBPE] = {}


def encoder(file: str) -> ByteBPE:
    """The encoder of a vocabulary file, built once per Python process."""
    if file not in _loaded:
        _loaded[file] = ByteBPE(file)
    return _loaded[file]


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row: the token ids of its whole text, without special tokens.

    Strings that look like special tokens are ordinary text. NULL and empty texts give an empty
    list. Repeated rows come out repeatedly. No shuffle; text is read once, in Arrow batches.
    """
    file = f"{tokenizers}/{vocabulary}"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file)
        for batch in batches:
            found = [bpe.encode(t) for t in batch.column(0).to_pylist()]
            offsets = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(1), ids], names=[id_column, "ids"])

    return _mapped(documents, [id_column], text_column, kernel, "ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text_column: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """The ``keep`` columns of every row and its n_tokens BIGINT, 0 for NULL and empty texts."""
    file = f"{tokenizers}/{vocabulary}"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file)
        for batch in batches:
            found = [len(bpe.encode(t)) // 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.int64())], names=[*keep, "n_tokens"])

    return _mapped(documents, keep, text_column, kernel, "n_tokens bigint")


def _mapped(documents: DataFrame, keep: list[str], text_column: str, kernel, field: str) -> DataFrame:
    slim = documents.select(F.col(text_column).cast("string").alias("_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return slim.mapInArrow(kernel, f"{kinds}, {field}")
