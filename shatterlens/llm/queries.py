"""Queries over the training-data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shatterlens.llm.bpe import count_tokens, encode_corpus
from shatterlens.llm.mixing import mix_report, mix_sources
from shatterlens.llm.neardup import near_duplicate_groups, near_duplicate_links, near_duplicates
from shatterlens.llm.pages import list_pages
from shatterlens.llm.replies import defective_replies
from shatterlens.llm.topn import top_n_per_group
from shatterlens.operators.records import current_rows
from shatterlens.scratch import Scratch
from shatterlens.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best records of every target family."""
    records = table(spark, sf_dir, "search_records")
    columns = ["idx", "target_family", "valid", "rank_score", "deleted_at"]
    now = current_rows(records, ["run_id", "node_id"], "ingested_at", columns)
    family = F.nullif(F.lower(F.trim("target_family")), F.lit(""))
    fit = now.where(F.col("valid") & F.col("deleted_at").isNull() & (F.col("rank_score") >= 0) & ~F.isnan("rank_score"))
    fit = fit.select("run_id", "node_id", "idx", "rank_score", family.alias("target_family"))
    best = top_n_per_group(fit, "target_family", "rank_score", 6, [F.asc("idx"), F.asc("run_id"), F.asc("node_id")])
    return best.select("target_family", "place", "run_id", "node_id")


def _programs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str, Column]:
    return table(spark, sf_dir, "candidate_programs"), "candidate_id", "code", F.coalesce(F.lower(F.trim("family")), F.lit("unknown"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of slightly altered programs of a family."""
    pairs = near_duplicates(*_programs(spark, sf_dir))
    return pairs.select(F.col("id_a").alias("candidate_id_a"), F.col("id_b").alias("candidate_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that such pairs form, named by their least member; from links of classes and their members, without pairs of copies."""
    groups = near_duplicate_groups(near_duplicate_links(*_programs(spark, sf_dir)))
    return groups.select(F.col("node").alias("candidate_id"), F.col("component").alias("group_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective replies and their defect."""
    return defective_replies(table(spark, sf_dir, "llm_calls"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return Scratch(spark).save(counted.withColumnRenamed("doc_id", "id"), "sizes")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    mix = mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
    return mix.withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every listed source."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mix_report(sizes, targets, mix_sources(sizes, targets))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of keywords, links, tags or menu paths."""
    return list_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p6_ids": p6_ids,
    "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found,
}

_PAIRS = """
    WITH RECURSIVE p AS (
        SELECT DISTINCT candidate_id, coalesce(lower(trim(family, ' ')), 'unknown') AS family, regexp_extract_all(lower(code), '[a-z0-9_]+') AS w
        FROM candidate_programs WHERE code IS NOT NULL),
    s AS (
        SELECT candidate_id, family, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS items
        FROM p WHERE len(w) >= 20),
    e AS (SELECT candidate_id, family, len(items) AS n, unnest(items) AS item FROM s),
    shared AS (
        SELECT a.candidate_id AS candidate_id_a, b.candidate_id AS candidate_id_b, a.n + b.n AS total, count(*) AS common
        FROM e a JOIN e b ON a.family = b.family AND a.item = b.item AND a.candidate_id < b.candidate_id
        GROUP BY ALL),
    pairs AS (SELECT candidate_id_a, candidate_id_b FROM shared WHERE 10 * common >= 7 * (total - common))
"""

ORACLES = {
    "p1_found": """
        WITH now AS (
            SELECT run_id, node_id, idx, target_family, valid, rank_score, deleted_at,
                   row_number() OVER (PARTITION BY run_id, node_id ORDER BY ingested_at DESC) AS n
            FROM search_records),
        fit AS (
            SELECT run_id, node_id, idx, rank_score, lower(trim(target_family)) AS target_family FROM now
            WHERE n = 1 AND valid AND deleted_at IS NULL AND rank_score >= 0 AND NOT isnan(rank_score)
              AND trim(target_family) <> ''),
        placed AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY target_family ORDER BY rank_score DESC, idx, run_id, node_id) AS INTEGER) AS place
            FROM fit)
        SELECT target_family, place, run_id, node_id FROM placed WHERE place <= 6""",
    "p4_found": _PAIRS + "SELECT * FROM pairs",
    "p4_groups": _PAIRS + """,
    links AS (SELECT candidate_id_a AS x, candidate_id_b AS y FROM pairs UNION ALL SELECT candidate_id_b, candidate_id_a FROM pairs),
    reach AS (SELECT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
    SELECT x AS candidate_id, min(y) AS group_id FROM reach GROUP BY x""",
}
