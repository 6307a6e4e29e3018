"""Programs of a family that are slightly altered versions of each other.

A program is the set of its word shingles. Its fingerprint has one bit of each of SEGMENTS *
SEGMENT_BITS MinHashes, so that the expected Hamming distance of two fingerprints is (1 - J) / 2
of their length. Multi-index hashing finds close fingerprints: every 16-bit segment has its own
table, the Hamming ball of radius 1 around a segment is looked up in it, and matches are verified
by their complete distance, then exactly by their shingles.

At similarity 0.7 a segment is within radius 1 with probability 0.284, so a pair escapes all
24 segments with probability 0.0003, and the complete distance (57.6 on average, deviation 7.0)
passes MAX_DISTANCE with probability 1e-6. Unrelated programs (J below 0.2) are never within it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shatterlens.operators.components import connected_components
from shatterlens.scratch import Scratch

SEGMENTS, SEGMENT_BITS = 24, 16
WORDS = SEGMENTS * SEGMENT_BITS // 64
MAX_DISTANCE = 92
#: Greatest number of programs of a family that one task takes with all their tables.
LOCAL_ROWS = 20_000
#: Pairs that are compared at a time, and fingerprints of a block of a larger family; a task holds two blocks.
BLOCK, BUCKET_ROWS = 1 << 20, 30_000
#: Sets that one is compared with at a time.
PARTNERS = 4_096
SHINGLE, LEAST_WORDS, SIMILARITY = 3, 20, 0.7

_WORD = re.compile(r"[a-z0-9_]+")
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**32, SEGMENTS * SEGMENT_BITS, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
_B = _rng.integers(0, 2**32, SEGMENTS * SEGMENT_BITS, dtype=np.uint64).astype(np.uint32)[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
_FLIPS = np.concatenate([[0], 1 << np.arange(SEGMENT_BITS)]).astype(np.int64)


class _Hashes(dict):
    """64-bit hash of a word, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hash_of = _Hashes()


def shingles(code: str | None, size: int = SHINGLE, least_words: int = LEAST_WORDS) -> np.ndarray | None:
    """Sorted distinct 32-bit hashes of the runs of ``size`` words; None for fewer than ``least_words`` words."""
    words = _WORD.findall(code.lower()) if code else ()
    if len(words) < max(least_words, size):
        return None
    h = np.fromiter(map(_hash_of.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    out = h[:n].copy()
    for i in range(1, size):
        out = (out ^ (out >> _MIX[2])) * _MIX[0] + h[i : i + n] * _MIX[1]
    out ^= out >> _MIX[2]
    return np.unique((out * _MIX[0] >> np.uint64(32)).astype(np.uint32))


def fingerprint(items: np.ndarray) -> bytes:
    """One bit of each MinHash of a set of 32-bit hashes."""
    least = (items[None, :] * _A + _B).min(axis=1)
    least ^= least >> np.uint32(15)
    bits = (least * np.uint32(0x2C1B3C6D)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _close(prints: np.ndarray, first: int | None = None) -> Iterator[np.ndarray]:
    """Index pairs i < j within MAX_DISTANCE that share a ball in some segment, each once, in blocks of bounded size.

    A pair comes out at the first segment that finds it, so that no table of pairs is kept. With ``first``
    only the pairs of one of the ``first`` leading rows and one of the others come out.
    """
    begin, upto_row = (0, len(prints)) if first is None else (first, first)
    if begin == len(prints):
        return
    keys = prints.view("<u2")  # n x SEGMENTS
    words = prints.view("<u8")
    for s in range(SEGMENTS):
        key = keys[:, s].astype(np.int64)
        order = np.argsort(key[begin:], kind="stable") + begin
        start = np.searchsorted(key[order], np.arange((1 << SEGMENT_BITS) + 1))
        for flip in _FLIPS:
            near = key[:upto_row] ^ flip
            count = start[near + 1] - start[near]
            upto = np.cumsum(count)
            at = 0
            while at < upto_row:  # as many lookups as give about BLOCK pairs, at least one
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, side="right")))
                c = count[at:end]
                i = np.repeat(np.arange(at, end), c)
                offset = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                j = order[start[near[i]] + offset]
                keep = i < j
                i, j = i[keep], j[keep]
                if s:  # most of what comes again came with the first segment
                    keep = np.bitwise_count(keys[i, 0] ^ keys[j, 0]) > 1
                    i, j = i[keep], j[keep]
                keep = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= MAX_DISTANCE
                i, j = i[keep], j[keep]
                if s and len(i):
                    earlier = (np.bitwise_count(keys[i, :s] ^ keys[j, :s]) <= 1).any(axis=1)
                    i, j = i[~earlier], j[~earlier]
                if len(i):
                    yield np.stack([i, j], axis=1)
                at = end


class _Shared:
    """Sizes of intersections of one set with many, over items numbered within a family."""

    def __init__(self, sets: list[np.ndarray]):
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        names, self.items = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), dtype=bool)

    def counts(self, i: int, others: np.ndarray) -> np.ndarray:
        """Items that set ``i`` shares with each of ``others``; no set is empty."""
        own = self.items[self.start[i] : self.start[i + 1]]
        self.mark[own] = True
        size = self.start[others + 1] - self.start[others]
        upto = np.cumsum(size)
        at = np.arange(upto[-1]) + np.repeat(self.start[others] - (upto - size), size)
        out = np.add.reduceat(self.mark[self.items[at]], upto - size, dtype=np.int64)
        self.mark[own] = False
        return out

    def similar(self, pairs: np.ndarray, similarity: float) -> np.ndarray:
        """The pairs, sorted by their first set, whose Jaccard similarity is at least ``similarity``."""
        size = np.diff(self.start)
        low, high = np.minimum(*size[pairs].T), np.maximum(*size[pairs].T)
        pairs = pairs[low >= similarity * high - 1e-9]
        good = []
        for own in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else ():
            for at in range(0, len(own), PARTNERS):
                i, j = own[0, 0], own[at : at + PARTNERS, 1]
                shared = self.counts(i, j)
                keep = shared >= similarity * (size[i] + size[j] - shared) - 1e-9
                good.append(own[at : at + PARTNERS][keep])
        return np.concatenate(good) if good else pairs


def _class_name(ids: pd.Series, items: bytes) -> str:
    """Name of a class of equal sets: its least id, NUL, a hash of the set."""
    return f"{ids.min()}\0{xxhash.xxh64_hexdigest(items)}"


def _family_links(similarity: float):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).drop_duplicates(["id", "items"])  # at most ``local_rows`` rows
        if len(pdf) < 2:
            return
        family = pdf["family"].iat[0]
        rows = lambda a, b, link: pd.DataFrame({"family": family, "a": a, "b": b, "link": link})
        names, sets = [], []
        for items, ids in pdf.groupby("items")["id"]:
            names.append(_class_name(ids, items))
            sets.append(np.frombuffer(items, dtype="<u4"))
            if len(ids) > 1:
                yield rows(names[-1], ids.to_numpy(), False)
        if len(sets) < 2:
            return
        prints = np.stack([np.frombuffer(fingerprint(x), dtype=np.uint8) for x in sets])
        named, shared = np.array(names, dtype=object), _Shared(sets)
        for pairs in _close(prints):
            good = shared.similar(pairs, similarity)
            if len(good):
                yield rows(named[good[:, 0]], named[good[:, 1]], True)

    return kernel


def _sets(size: int, least_words: int):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(c, size, least_words) for c in pdf["code"]]
            yield pdf[["id", "family"]].assign(items=[None if x is None else x.tobytes() for x in found])[[x is not None for x in found]]

    return kernel


_PRINT = [f"f{k}" for k in range(WORDS)]


def _printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.drop_duplicates(["family", "id", "h"])
        words = np.array([np.frombuffer(fingerprint(np.frombuffer(x, dtype="<u4")), dtype="<i8") for x in pdf["items"]], dtype=np.int64).reshape(-1, WORDS)
        yield pdf[["family", "id", "h"]].assign(**{f: words[:, k] for k, f in enumerate(_PRINT)})


def _prints_of(pdf: pd.DataFrame) -> tuple[np.ndarray, int | None]:
    """Fingerprints of rows that are sorted by block, and how many rows the first of two blocks has."""
    first = None if pdf["p"].iat[0] == pdf["q"].iat[0] else int((pdf["block"] == pdf["p"]).sum())
    return np.ascontiguousarray(pdf[_PRINT].to_numpy(dtype="<i8")).view(np.uint8), first


def _merged(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels of parts, each its least row's number, once the ends of ``pairs`` belong together."""
    while len(pairs):
        ends = np.unique(label[pairs], axis=0)
        pairs = ends[ends[:, 0] != ends[:, 1]]
        np.minimum.at(label, pairs.max(axis=1, initial=0), pairs.min(axis=1, initial=len(label)))
        while not np.array_equal(below := label[label], label):
            label = below
    return label


def _parted(part_rows: int):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")  # the rows of at most two blocks
        prints, first = _prints_of(pdf)
        label = np.arange(len(pdf))
        for pairs in _close(prints, first):
            label = _merged(label, pairs)
        kept = np.flatnonzero(np.bincount(label)[label] > 1)
        kept = kept[np.argsort(label[kept], kind="stable")]
        start = np.searchsorted(label[kept], label[kept])  # place of each part's first row
        return pdf.iloc[kept].assign(part=start // part_rows)

    return kernel


def _part_links(similarity: float):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("block", kind="stable", ignore_index=True)
        prints, first = _prints_of(pdf)
        shared = _Shared([np.frombuffer(x, dtype="<u4") for x in pdf["items"]])
        named = np.array([f"{i}\0{h}" for i, h in zip(pdf["id"], pdf["h"])], dtype=object)
        family = pdf["family"].iat[0]
        del pdf
        for pairs in _close(prints, first):
            good = shared.similar(pairs, similarity)
            if len(good):
                yield pd.DataFrame({"family": family, "a": named[good[:, 0]], "b": named[good[:, 1]], "link": True})

    return kernel


_LINK = "family string, a string, b string, link boolean"


def _large_links(scratch: Scratch, sets: DataFrame, similarity: float, bucket_rows: int) -> DataFrame:
    """The same over families of any size.

    Fingerprints of a family's classes are cut into blocks of about ``bucket_rows``, and every two blocks meet in one task, which
    gives the parts that no close pair leaves. Only what has a close fingerprint is sent on with its set, once a part; parts are
    packed and go through the steps of a small family. So no pair carries its sets, and no lookup is a row.
    """
    f = ", ".join(f"{w} bigint" for w in _PRINT)
    rows = sets.select("family", "id", F.md5("items").alias("h"), "items")
    prints = scratch.save(rows.mapInPandas(_printed, f"family string, id string, h string, {f}"), "prints")
    classes = prints.groupBy("family", "h").agg(F.min("id").alias("id"), (F.min("id") != F.max("id")).alias("many"), *[F.first(w).alias(w) for w in _PRINT])
    classes = scratch.save(classes, "classes")
    many = classes.where("many").select("family", "h", F.concat("id", F.lit("\0"), "h").alias("a"))
    members = prints.join(many, ["family", "h"]).select("family", "a", F.col("id").alias("b"), F.lit(False).alias("link")).distinct()
    blocks = classes.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("blocks"))
    placed = classes.drop("many").join(F.broadcast(blocks), "family").withColumn("block", F.pmod(F.xxhash64("h"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("blocks", "other")
    keys = ["family", "p", "q"]
    parts = placed.groupBy(*keys).applyInPandas(_parted(LOCAL_ROWS // 4), f"family string, h string, id string, {f}, block int, p int, q int, part bigint")
    parts = scratch.save(parts, "parts")
    whole = parts.join(rows.dropDuplicates(["family", "id", "h"]), ["family", "id", "h"])
    return whole.groupBy(*keys, "part").applyInPandas(_part_links(similarity), _LINK).unionByName(members)


def near_duplicate_links(programs: DataFrame, id_column: str, code_column: str, family: Column, similarity: float = SIMILARITY, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, local_rows: int = LOCAL_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(family, a, b, link): links between classes of equal sets, and the members of classes of several.

    With ``link`` true, a and b are the names of two similar classes; else b is the id of a member of the class a. A class is
    named by its least id, NUL and a hash; classes of one id have no rows of members. The result grows with links between
    different texts and not with pairs of copies. Words are the runs of a-z, 0-9 and _ of the lower-cased code. NULL ids and codes, and codes of
    fewer than ``least_words`` words, take no part. Repeated rows count once. ``family`` is compared as it is, NULL is a
    family. A family of up to ``local_rows`` rows is one task with all tables in memory; a larger one goes through the same steps
    in blocks of ``bucket_rows``. Sets are held as 32-bit hashes: a pair's similarity is off by one shingle with probability below 1e-5.
    """
    scratch = Scratch(programs.sparkSession)
    slim = programs.where(F.col(id_column).isNotNull() & F.col(code_column).isNotNull())
    slim = slim.select(F.col(id_column).alias("id"), F.coalesce(family, F.lit("\0")).alias("family"), F.col(code_column).alias("code"))
    big = slim.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_rows).select("family")
    big = scratch.save(big, "big")  # at most rows / local_rows of them
    sets = slim.mapInPandas(_sets(shingle, least_words), "id string, family string, items binary")
    if big.isEmpty():
        return scratch.save(sets.groupBy("family").applyInPandas(_family_links(similarity), _LINK), "links")
    sets = scratch.save(sets, "all")
    small = sets.join(F.broadcast(big), "family", "left_anti").groupBy("family").applyInPandas(_family_links(similarity), _LINK)
    large = _large_links(scratch, sets.join(F.broadcast(big), "family", "left_semi"), similarity, bucket_rows)
    return scratch.save(small.unionByName(large), "links")


def id_of(name: Column) -> Column:
    """The least id of a class of that name."""
    return F.regexp_replace(name, "(?s)\0[0-9a-f]*$", "")


def near_duplicates(programs: DataFrame, id_column: str, code_column: str, family: Column, similarity: float = SIMILARITY, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, local_rows: int = LOCAL_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of distinct ids of a family whose shingle sets have Jaccard similarity of at least ``similarity``.

    The links of ``near_duplicate_links``, whose cases hold here too, with the members of both ends; copies are joined in this last step only.
    """
    rows = near_duplicate_links(programs, id_column, code_column, family, similarity, shingle, least_words, local_rows, bucket_rows)
    members = rows.where(~F.col("link")).select("family", F.col("a").alias("c"), F.col("b").alias("id"))
    pairs = rows.where("link").select("family", "a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(members.withColumnsRenamed({"c": end, "id": f"id_{end}"}), ["family", end], "left").withColumn(f"id_{end}", F.coalesce(f"id_{end}", id_of(F.col(end))))
    copies = members.withColumnRenamed("id", "id_a").join(members.withColumnRenamed("id", "id_b"), ["family", "c"]).where(F.col("id_a") < F.col("id_b"))
    both = pairs.where(F.col("id_a") != F.col("id_b")).select("id_a", "id_b").unionByName(copies.select("id_a", "id_b"))
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def near_duplicate_groups(links: DataFrame) -> DataFrame:
    """(node, component) of every id with a link or a copy, from the rows of ``near_duplicate_links``; the component is its least id."""
    other = F.when(F.col("link"), id_of(F.col("b"))).otherwise(F.col("b"))
    return connected_components(links.select(id_of(F.col("a")).alias("a"), other.alias("b")).where(F.col("a") != F.col("b")), "a", "b")
