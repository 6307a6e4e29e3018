"""Queries over the general data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shatterlens.operators.hierarchy import hierarchy, hierarchy_below, hierarchy_paths
from shatterlens.operators.orphans import orphan_report, plain_path, record_orphans, reference_or_null, resolve_references
from shatterlens.operators.records import current_rows
from shatterlens.scratch import Scratch
from shatterlens.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of every record."""
    return record_orphans(table(spark, sf_dir, "search_records"), table(spark, sf_dir, "candidate_files"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per field, kind and month."""
    return orphan_report(p2_found(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, descendants and state of every record."""
    return hierarchy(table(spark, sf_dir, "search_records")).drop("pre")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path from the root of every record on a tree."""
    return hierarchy_paths(table(spark, sf_dir, "search_records"))


def p3_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with each of the records below it."""
    return hierarchy_below(table(spark, sf_dir, "search_records"))


def p2_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose file and code hash, as far as they are given, no registered file of the run has: a key of three columns with NULLs.

    ``absent`` tells which columns are NULL: 1 for the path, 2 for the hash. Records without both refer to nothing.
    """
    now = current_rows(table(spark, sf_dir, "search_records"), ["run_id", "node_id"], "ingested_at", ["candidate_file", "code_hash"])
    refs = now.select("run_id", "node_id", plain_path(reference_or_null(F.col("candidate_file"))).alias("path"), reference_or_null(F.col("code_hash")).alias("hash"))
    refs = Scratch(spark).save(refs.where(F.col("path").isNotNull() | F.col("hash").isNotNull()), "refs")
    files = table(spark, sf_dir, "candidate_files").select("run_id", plain_path(F.col("candidate_file")).alias("path"), F.col("code_hash").alias("hash"))
    found = resolve_references(refs, ["run_id", "path", "hash"], files, ["run_id", "path", "hash"], match="partial")
    absent = F.when(F.col("path").isNull(), 1).otherwise(0) + F.when(F.col("hash").isNull(), 2).otherwise(0)
    return found.where(~F.col("_hit")).select("run_id", "node_id", absent.alias("absent"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_partial": p2_partial, "p3_found": p3_found, "p3_paths": p3_paths, "p3_below": p3_below}

_P2 = r"""
    WITH d AS (
        SELECT *, row_number() OVER (PARTITION BY run_id, node_id ORDER BY ingested_at DESC) AS n,
               min(ingested_at) OVER (PARTITION BY run_id, node_id) AS arrival
        FROM search_records),
    cur AS (SELECT *, coalesce(logged_at, arrival) AS moment FROM d WHERE n = 1),
    f AS (
        SELECT regexp_replace(regexp_replace(replace(candidate_file, '\', '/'), '/+', '/', 'g'), '^\./', '') AS path, ingested_at, deleted_at
        FROM candidate_files WHERE candidate_file IS NOT NULL),
    fn AS (
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY ingested_at DESC) AS n, min(ingested_at) OVER (PARTITION BY path) AS arrival FROM f),
    refs AS (
        SELECT c.run_id, c.node_id, 'parent_id' AS ref_field, c.moment, c.arrival, t.node_id IS NOT NULL AS hit, t.deleted_at AS gone, t.arrival AS came
        FROM cur c LEFT JOIN cur t ON t.run_id = c.run_id AND t.node_id = c.parent_id
        WHERE NOT regexp_full_match(c.parent_id, '\s*(nan|None)?\s*')
        UNION ALL
        SELECT c.run_id, c.node_id, 'candidate_file', c.moment, c.arrival, t.path IS NOT NULL, t.deleted_at, t.arrival
        FROM cur c LEFT JOIN (SELECT * FROM fn WHERE n = 1) t
          ON t.path = regexp_replace(regexp_replace(replace(c.candidate_file, '\', '/'), '/+', '/', 'g'), '^\./', '')
        WHERE NOT regexp_full_match(c.candidate_file, '\s*(nan|None)?\s*')),
    found AS (
        SELECT run_id, node_id, ref_field, CASE WHEN NOT hit THEN 'missing' WHEN gone <= moment THEN 'deleted' WHEN came > arrival THEN 'late' END AS kind,
               strftime(moment, '%Y-%m') AS period
        FROM refs)
"""

_P3 = """
    WITH RECURSIVE d AS (
        SELECT run_id, node_id, parent_id, row_number() OVER (PARTITION BY run_id, node_id ORDER BY ingested_at DESC) AS n FROM search_records),
    cur AS (SELECT c.run_id, c.node_id, p.node_id AS parent_id FROM (SELECT * FROM d WHERE n = 1) c
            LEFT JOIN (SELECT run_id, node_id FROM d WHERE n = 1) p ON p.run_id = c.run_id AND p.node_id = c.parent_id),
    up AS (
        SELECT run_id, node_id, parent_id AS above FROM cur WHERE parent_id IS NOT NULL
        UNION
        SELECT u.run_id, u.node_id, c.parent_id FROM up u JOIN cur c ON c.run_id = u.run_id AND c.node_id = u.above WHERE c.parent_id IS NOT NULL),
    ring AS (SELECT run_id, node_id FROM up WHERE above = node_id),
    lost AS (SELECT DISTINCT u.run_id, u.node_id FROM up u JOIN ring r ON r.run_id = u.run_id AND r.node_id = u.above),
    high AS (SELECT run_id, node_id, count(*) AS depth FROM up GROUP BY ALL),
    tops AS (SELECT u.run_id, u.node_id, u.above AS root_id FROM up u JOIN cur c ON c.run_id = u.run_id AND c.node_id = u.above WHERE c.parent_id IS NULL),
    low AS (SELECT run_id, above AS node_id, count(*) AS n FROM up WHERE above <> node_id GROUP BY ALL)
"""

ORACLES = {
    "p2_found": _P2 + "SELECT * FROM found WHERE kind IS NOT NULL",
    "p2_report": _P2 + "SELECT ref_field, kind, period, count(*) AS n FROM found WHERE kind IS NOT NULL GROUP BY ALL",
    "p2_partial": r"""
        WITH now AS (
            SELECT run_id, node_id, row_number() OVER (PARTITION BY run_id, node_id ORDER BY ingested_at DESC) AS n,
                   CASE WHEN NOT regexp_full_match(candidate_file, '\s*(nan|None)?\s*') THEN regexp_replace(regexp_replace(replace(candidate_file, '\', '/'), '/+', '/', 'g'), '^\./', '') END AS path,
                   CASE WHEN NOT regexp_full_match(code_hash, '\s*(nan|None)?\s*') THEN code_hash END AS hash
            FROM search_records),
        f AS (SELECT run_id, regexp_replace(regexp_replace(replace(candidate_file, '\', '/'), '/+', '/', 'g'), '^\./', '') AS path, code_hash AS hash FROM candidate_files)
        SELECT run_id, node_id, CAST(CASE WHEN path IS NULL THEN 1 ELSE 0 END + CASE WHEN hash IS NULL THEN 2 ELSE 0 END AS INTEGER) AS absent
        FROM now WHERE n = 1 AND (path IS NOT NULL OR hash IS NOT NULL)
          AND NOT EXISTS (SELECT 1 FROM f WHERE f.run_id = now.run_id AND (now.path IS NULL OR f.path = now.path) AND (now.hash IS NULL OR f.hash = now.hash))""",
    "p3_below": _P3 + "SELECT run_id, above AS node_id, node_id AS below_id FROM up WHERE above <> node_id",
    "p3_found": _P3 + """
        SELECT c.run_id, c.node_id,
               CASE WHEN l.node_id IS NOT NULL THEN '' WHEN c.parent_id IS NULL THEN c.node_id ELSE t.root_id END AS root_id,
               CAST(CASE WHEN l.node_id IS NOT NULL THEN -1 ELSE coalesce(h.depth, 0) END AS INTEGER) AS depth,
               CAST(coalesce(w.n, 0) AS BIGINT) AS n_descendants,
               CASE WHEN r.node_id IS NOT NULL THEN 'cycle' WHEN l.node_id IS NOT NULL THEN 'below_cycle' ELSE 'tree' END AS state
        FROM cur c LEFT JOIN lost l USING (run_id, node_id) LEFT JOIN ring r USING (run_id, node_id) LEFT JOIN high h USING (run_id, node_id)
        LEFT JOIN tops t USING (run_id, node_id) LEFT JOIN low w USING (run_id, node_id)""",
    "p3_paths": """
        WITH RECURSIVE d AS (
            SELECT run_id, node_id, parent_id, row_number() OVER (PARTITION BY run_id, node_id ORDER BY ingested_at DESC) AS n FROM search_records),
        cur AS (SELECT c.run_id, c.node_id, p.node_id AS parent_id FROM (SELECT * FROM d WHERE n = 1) c
                LEFT JOIN (SELECT run_id, node_id FROM d WHERE n = 1) p ON p.run_id = c.run_id AND p.node_id = c.parent_id),
        down AS (
            SELECT run_id, node_id, node_id AS path FROM cur WHERE parent_id IS NULL
            UNION ALL
            SELECT c.run_id, c.node_id, p.path || '/' || c.node_id FROM down p JOIN cur c ON c.run_id = p.run_id AND c.parent_id = p.node_id)
        SELECT * FROM down""",
}
