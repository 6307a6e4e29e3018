"""A training mix whose sources come close to target shares, with capped repetition."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shatterlens.scratch import Scratch

#: Documents of one source that one task rounds, about.
BUCKET_ROWS = 50_000
#: Residuals of one source that one task of the reduction tree combines.
FAN_IN = 512
#: Sources in the target table up to which it is broadcast.
BROADCAST_SOURCES = 10_000
#: A document this many times as long as the mean of the shorter ones is settled against all of them.
OUTSIZED = 8
_NEAR = 1e-9
_COLUMNS = ["id", "source", "n_tokens", "base", "p", "bucket"]


def settle_outsized(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> int:
    """Round documents far longer than those after them, in place, where all have the same p; how many.

    Such a document is paired with all shorter ones together, which share the mass moved evenly: one by
    one they would seldom move enough to settle it, and its rounding at the end would miss the target by its length.
    """
    n = len(p)
    if n < 2 or p[0] - p.min() > _NEAR or p.max() - p[0] > _NEAR:
        return 0
    left, at = float(size.sum()), float(p[0])
    for i in range(n - 1):
        left -= size[i]
        if size[i] <= OUTSIZED * left / (n - 1 - i) or not _NEAR < at < 1 - _NEAR:
            break
        up, down = min((1 - at) * size[i], at * left), min(at * size[i], (1 - at) * left)
        move = up if draws[i] * (up + down) < down else -down
        p[i] = at + move / size[i]
        at -= move / left
        p[i + 1 :] = at
    else:
        return n - 1
    return i


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round probabilities to 0 and 1 in pairs, keeping sum(p * size) and the mean of each; at most one stays between.

    Of a pair, the mass that one can take from the other until either is integral is moved one way
    or the other, at random such that both keep their expectation.
    """
    p = p.astype(float).copy()
    draws = rng.random(len(p))
    settle_outsized(p, size, draws)
    draws = rng.random(len(p))
    held = -1
    for i in range(len(p)):
        if not _NEAR < p[i] < 1 - _NEAR:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up, down = min((1 - p[held]) * a, p[i] * b), min(p[held] * a, (1 - p[i]) * b)
        move = up if draws[i] * (up + down) < down else -down
        p[held] += move / a
        p[i] -= move / b
        free = [j for j in (held, i) if _NEAR < p[j] < 1 - _NEAR]
        for j in (held, i):
            if j not in free:
                p[j] = round(p[j])
        held = free[0] if free else -1
    return p


def _rounder(seed: int, level: int, last: bool):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_order", "id"], ascending=[False, True, True], ignore_index=True)  # what stays between is then a short one
        source, bucket = pdf["source"].iat[0], int(pdf["bucket"].iat[0])
        rng = np.random.default_rng([seed, level, bucket, zlib.crc32(str(source).encode("utf-8", "replace"))])
        p = pivot(pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy(float), rng)
        if last:
            p = np.where((p > 0) & (p < 1), rng.random(len(p)) < p, p).astype(float)
        return pdf.assign(p=p)[_COLUMNS]

    return kernel


def source_targets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, tokens, total, copies): copies each document is due, as a fraction.

    ``total`` are the tokens of all of ``sizes``, listed or not. Rows of the same source add up
    their shares and take the greatest cap; NULL sources, and NULL or negative shares, get none; a
    NULL cap is 1. A source without tokens is due no copies.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats")
    )
    per_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("tokens"))
    total = int(per_source.agg(F.sum("tokens")).first()[0] or 0)
    out = wanted.join(per_source, "source", "left").na.fill(0, ["n_documents", "tokens"]).withColumn("total", F.lit(total).cast("long"))
    due = F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("total") / F.col("tokens"))
    return out.withColumn("copies", F.when(F.col("tokens") > 0, due).otherwise(0.0))


def mix_sources(sizes: DataFrame, targets: DataFrame, seed: int = 17, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(id, source, n_tokens, copies INT) of the documents drawn at least once.

    ``sizes`` has id, source, n_tokens (a stored table, as it is read several times). Every document
    of a source is due the same fractional number of copies, at most its ``max_repeats``. The whole
    part is given; the fractions are rounded by pivotal dependent rounding: documents of a
    source meet in buckets of bounded size, mass moves between two until one is integral, and the
    one residual of each bucket goes up a reduction tree. So the tokens of a source miss its
    target by less than one document, each document keeps its expected number of copies, and the result depends
    on ids and ``seed`` only, not on partitions. Documents without tokens, and of NULL or unlisted
    sources, are not drawn; repeated rows are drawn separately. Empty tables give no rows.
    """
    scratch = Scratch(sizes.sparkSession)
    sizes = sizes.select("id", "source", "n_tokens")
    due = scratch.save(source_targets(sizes, targets).where(F.col("copies") > 0).select("source", F.col("copies").alias("_due")), "due")
    small = due.count() <= BROADCAST_SOURCES
    rows = sizes.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).join(F.broadcast(due) if small else due, "source")
    buckets = max(1, -(-sizes.count() // bucket_rows))
    order = F.xxhash64("id", F.lit(seed))
    base = F.floor(F.col("_due") + _NEAR)
    part = rows.select("id", "source", "n_tokens", base.cast("int").alias("base"), F.greatest(F.col("_due") - base, F.lit(0.0)).alias("p"), F.pmod(order, F.lit(buckets)).alias("bucket"))
    kind = sizes.schema["id"].dataType.simpleString()
    schema = f"id {kind}, source string, n_tokens bigint, base int, p double, bucket bigint"
    done, level = None, 0
    while True:
        last = buckets == 1
        rounded = part.withColumn("_order", F.xxhash64("id", F.lit(seed), F.lit(1))).groupBy("source", "bucket").applyInPandas(_rounder(seed, level, last), schema)
        rounded = scratch.save(rounded, f"level{level}")
        whole = rounded.where((F.col("p") == 0) | (F.col("p") == 1))
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        part = rounded.where((F.col("p") != 0) & (F.col("p") != 1)).withColumn("bucket", F.expr(f"bucket div {fan_in}"))
        buckets, level = -(-buckets // fan_in), level + 1
    return done.select("id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")).where(F.col("copies") > 0)


def mix_report(sizes: DataFrame, targets: DataFrame, mix: DataFrame) -> DataFrame:
    """Per listed source: its target, what it holds, what was drawn and the share of ``total`` that this reaches."""
    drawn = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"), F.sum("copies").alias("documents_drawn"), F.max("copies").alias("most_copies"))
    out = source_targets(sizes, targets).drop("copies").join(drawn, "source", "left").na.fill(0, ["tokens_drawn", "documents_drawn", "most_copies"])
    reached = F.when(F.col("total") > 0, F.col("tokens_drawn") / F.col("total")).otherwise(0.0)
    return out.withColumn("share_reached", reached)
