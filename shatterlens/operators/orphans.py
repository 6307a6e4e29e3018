"""References to records that do not exist, are deleted or arrive later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shatterlens.operators.records import current_rows
from shatterlens.operators.skew import lookup_join
from shatterlens.scratch import Scratch

MATCHES = ("simple", "partial", "full", "as_stored")


def resolve_references(refs: DataFrame, ref_keys: Sequence[str], targets: DataFrame, target_keys: Sequence[str], carry: Sequence[str] = (), match: str = "simple", **hot) -> DataFrame:
    """``refs`` with ``_hit`` (BOOLEAN) and the ``carry`` columns of the target it names.

    The references are grouped by the null mask of their composite key; each group is anti-joined
    on its non-null columns only. The anti-join is run as an outer join that keeps its unmatched
    side (``_hit`` false), so one shuffle gives both the orphans and the state of found targets.

    match: ``simple``    a key with any NULL is no reference: it counts as found;
           ``partial``   NULLs match anything: a target must agree on the non-null columns;
           ``full``      a key of NULLs only counts as found, one with some NULLs never is;
           ``as_stored`` NULL equals NULL.
    Targets may repeat; of equal keys the one with the greatest ``carry`` counts. Under ``partial``
    a key of NULLs only counts as found. ``carry`` columns are NULL where nothing was looked up.
    ``refs`` should be a stored table, as it is read once per mask that occurs (at most 2^keys).
    Empty inputs give empty results; other columns pass through, also when a target has the same,
    but a reference's own ``_hit`` and columns named as in ``carry`` give way to those of the lookup.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    n = len(ref_keys)
    kept = [c for c in refs.columns if c not in ("_hit", *carry)]
    mask = F.lit(0)
    for i, k in enumerate(ref_keys):
        mask = mask + F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(0)
    tkeys = [f"_k{i}" for i in range(n)]
    slim = targets.select(*[F.col(k).alias(t) for k, t in zip(target_keys, tkeys)], *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    counted = refs.groupBy(mask.alias("_mask")).agg(F.count(F.lit(1)).alias("_n")).collect()  # at most 2^n rows
    none = [F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in carry]
    parts = []
    for row in sorted(counted, key=lambda r: r["_mask"]) or [None]:
        bits, total = (row["_mask"], row["_n"]) if row else (0, 0)
        own = refs.where(mask == bits).select(F.struct(*kept).alias("_ref"), *[F.col(k).alias(t) for k, t in zip(ref_keys, tkeys)])
        null = [i for i in range(n) if bits >> i & 1]
        live = [i for i in range(n) if not bits >> i & 1]
        if null and match in ("simple", "full") or not live and match == "partial":
            found = match != "full" or not live
            parts.append(own.select("_ref.*", F.lit(found).alias("_hit"), *none))
            continue
        side = slim.where(F.lit(True) if not live else ~F.greatest(*[F.col(tkeys[i]).isNull() for i in live], F.lit(False)))
        if match == "as_stored":
            for i in null:
                side = side.where(F.col(tkeys[i]).isNull())
        on = [tkeys[i] for i in live]
        if not on:  # all NULL, as stored: at most one target
            side = side.withColumn("_all", F.lit(0))
            on, own = ["_all"], own.withColumn("_all", F.lit(0))
        one = F.max(F.struct(*[f"_c{i}" for i in range(len(carry))], F.lit(1).alias("_one"))).alias("_t")
        side = side.groupBy(*on).agg(one)
        joined = lookup_join(own.select("_ref", *on), side, on, total, **hot)
        parts.append(joined.select("_ref.*", F.col("_t").isNotNull().alias("_hit"), *[F.col(f"_t._c{i}").alias(c) for i, c in enumerate(carry)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def orphan_references(refs: DataFrame, ref_keys: Sequence[str], targets: DataFrame, target_keys: Sequence[str], *, moment: str, arrival: str, target_deleted: str, target_arrival: str, match: str = "simple", **hot) -> DataFrame:
    """References with a ``kind``: ``missing``, ``deleted`` (at the reference's moment) or ``late``.

    The first kind that holds counts; sound references do not come out. NULL times compare to
    nothing: such a target is neither deleted nor late. ``period`` is the month of the moment.
    """
    found = resolve_references(refs, ref_keys, targets, target_keys, [target_deleted, target_arrival], match, **hot)
    kind = (
        F.when(~F.col("_hit"), "missing")
        .when(F.col(target_deleted) <= F.col(moment), "deleted")
        .when(F.col(target_arrival) > F.col(arrival), "late")
    )
    return found.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("period", month_of(F.col(moment)))


def month_of(t: Column) -> Column:
    """``yyyy-MM`` of a timestamp, whatever the session's time zone does."""
    return F.concat_ws("-", F.lpad(F.year(t).cast("string"), 4, "0"), F.lpad(F.month(t).cast("string"), 2, "0"))


def reference_or_null(c: Column) -> Column:
    """NULL for values that are no reference: NULL, blank, ``nan``, ``None``."""
    return F.when(~c.rlike(r"^\s*(nan|None)?\s*$"), c)


def plain_path(c: Column) -> Column:
    """A path with ``/`` only, no runs of it and no leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.translate(c, "\\", "/"), "/+", "/"), r"^\./", "")


def record_orphans(records: DataFrame, files: DataFrame) -> DataFrame:
    """Orphan references of search records: (run_id, node_id, ref_field, kind, period).

    ``parent_id`` is looked up among the records of the same run, ``candidate_file`` among the
    registered paths. Repeated deliveries count once; withdrawn records refer and are targets too.
    """
    scratch = Scratch(records.sparkSession)
    current = current_rows(records, ["run_id", "node_id"], "ingested_at", ["parent_id", "candidate_file", "logged_at", "deleted_at"], "_arrival")
    current = scratch.save(
        current.select(
            "run_id", "node_id", "deleted_at", "_arrival",
            F.coalesce("logged_at", "_arrival").alias("_moment"),
            reference_or_null(F.col("parent_id")).alias("parent_id"),
            plain_path(reference_or_null(F.col("candidate_file"))).alias("candidate_file"),
        ),
        "current",
    )
    slim = ["run_id", "node_id", "_moment", "_arrival"]
    times = {"moment": "_moment", "arrival": "_arrival", "target_deleted": "_t_deleted", "target_arrival": "_t_arrival"}
    targets = current.select("run_id", "node_id", F.col("deleted_at").alias("_t_deleted"), F.col("_arrival").alias("_t_arrival"))
    parents = orphan_references(current.where(F.col("parent_id").isNotNull()).select(*slim, "parent_id"), ["run_id", "parent_id"], targets, ["run_id", "node_id"], match="as_stored", **times)
    registered = current_rows(
        files.where(F.col("candidate_file").isNotNull()).select(plain_path(F.col("candidate_file")).alias("_path"), "ingested_at", F.col("deleted_at").alias("_t_deleted")),
        ["_path"], "ingested_at", ["_t_deleted"], "_t_arrival",
    )
    stored = orphan_references(current.where(F.col("candidate_file").isNotNull()).select(*slim, "candidate_file"), ["candidate_file"], registered, ["_path"], **times)
    out = ["run_id", "node_id", "ref_field", "kind", "period"]
    return parents.withColumn("ref_field", F.lit("parent_id")).select(*out).unionByName(stored.withColumn("ref_field", F.lit("candidate_file")).select(*out))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per referring field, kind and month."""
    return found.groupBy("ref_field", "kind", "period").agg(F.count(F.lit(1)).alias("n"))
