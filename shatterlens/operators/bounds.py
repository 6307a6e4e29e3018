"""Bound policies: what programs of the last stage may use, as a table of items.

A policy is (scope, part, item, value, place): ``part`` is ``family``, ``pruned``, ``signal``,
``forbidden``, ``cap`` or ``update``; ``value`` is JSON for caps and updates. Proposals are rows of
JSON text; each part of all of them is taken apart, cleaned, looked up and merged by joins and
aggregates over all scopes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Names of signals and what they stand for.
SIGNAL_ALIASES = {
    "degree": "residual_degree",
    "degree_backbone": "residual_degree",
    "residual_degree": "residual_degree",
    "neighbor_degree": "neighbor_degree",
    "two_hop": "bounded_two_hop",
    "two_hop_degree": "bounded_two_hop",
    "bounded_two_hop": "bounded_two_hop",
    "frontier": "frontier",
    "boundary": "boundary",
    "weak_tie": "weak_tie",
    "redundancy": "redundancy",
    "phase": "phase",
    "heap_update": "lazy_heap",
    "lazy_heap": "lazy_heap",
    "core_number": "core_number",
}
# Fixed value: words that rule a proposed name out.
DENIED = r"(?i)(disallow|forbid|must_exclude|global|unbounded|component_refresh|rescan|notes?|required|optional|may_include)"
# Patterns that are always forbidden.
ALWAYS_FORBIDDEN = (
    "all_pairs_shortest_path",
    "betweenness_recompute_each_step",
    "pagerank_or_eigenvector_recompute_each_step",
    "connected_components_each_step",
    "full_graph_sort_each_step",
    "full_graph_rescan_each_step",
    "unbounded_two_hop_scan",
    "unbounded_bfs_or_dfs",
    "nondeterministic_random_ordering",
)
# What proposed patterns mean.
FORBIDDING = {
    "component": "connected_components_each_step",
    "all_pairs|shortest": "all_pairs_shortest_path",
    "betweenness": "betweenness_recompute_each_step",
    "pagerank|eigenvector": "pagerank_or_eigenvector_recompute_each_step",
    "full.*(sort|rescan|recompute)|(sort|rescan|recompute).*full": "full_graph_rescan_each_step",
    "unbounded|bfs|dfs": "unbounded_bfs_or_dfs",
    "random|nondetermin": "nondeterministic_random_ordering",
}
# Signals of the statistics, and those that every policy allows.
BASE_SIGNALS = ("residual_degree", "neighbor_degree", "bounded_two_hop", "frontier", "boundary", "lazy_heap")
ALWAYS_ALLOWED = ("bounded_two_hop", "frontier", "boundary", "weak_tie", "redundancy", "phase", "lazy_heap")
# Families that every policy prunes, caps and updates of the statistics, and those that proposals cannot change.
PRUNED = ("global-centrality-recompute", "unbounded-path-search")
BASE_CAPS = {"max_neighbor_scan": "64", "max_two_hop_scan": "128"}
FIXED_CAPS = {"bounded_two_hop_required": "true", "forbid_policy_disabling_target_family_signals": "true", "phase_schedule_required": "true"}
BASE_UPDATES = {"avoid_global_rescan": "true", "heap_or_bucket_updates_allowed": "true", "mode": '"local_residual_update"'}
UPDATE_KEYS = ("mode", "strategy", "heap_policy", "refresh_scope")
FIXED_UPDATES = {"affected_scope": '"neighbors plus capped neighbors-of-neighbors; never full graph refresh"'}
# Caps of each branch.
BRANCH_CAPS = {
    "Q_like": {"neighbor_cap": [24, 32, 48, 64], "two_hop_cap": [16, 24, 32], "affected_cap": [18, 24, 32]},
    "S_like": {"neighbor_cap": [12, 16, 24], "two_hop_cap": [6, 8, 12], "affected_cap": [16, 20, 24]},
    "bridge": {"neighbor_cap": [16, 24, 32], "two_hop_cap": [8, 12, 16, 24], "affected_cap": [18, 24, 28]},
    "repair": {"neighbor_cap": [12, 16, 24, 32], "two_hop_cap": [6, 8, 12, 16], "affected_cap": [12, 16, 20, 24]},
}
MOST_PROPOSALS, MOST_FAMILIES, MOST_ITEMS = 10, 8, 8
NO_FAMILY = "degree-local"


def _kind(v: Column) -> Column:
    """text, number, boolean, list, map or nothing: what a VARIANT holds."""
    of = F.schema_of_variant(v)
    return F.when(of == "STRING", "text").when(of == "BOOLEAN", "boolean").when(of.startswith("ARRAY"), "list").when(of.startswith("OBJECT"), "map").when(of == "VOID", "nothing").otherwise("number")


def _scalar(v: Column) -> Column:
    return _kind(v).isin("text", "number", "boolean")


def _safe(key: Column) -> Column:
    return F.regexp_replace(F.trim(key), r"[^0-9A-Za-z_\-]+", "_")


def named(proposals: DataFrame, field: str) -> DataFrame:
    """(scope, proposal, place, name) of a field: a text, or a list of texts and of objects that name something."""
    whole = F.try_variant_get("policy", f"$.{field}", "variant")
    items = F.when(_kind(whole) == "text", F.array(whole)).when(_kind(whole) == "list", F.try_variant_get("policy", f"$.{field}", "array<variant>"))
    rows = proposals.select("scope", "proposal", F.posexplode(items).alias("place", "item"))
    inner = [F.when(_kind(F.try_variant_get("item", f"$.{k}", "variant")) == "text", F.try_variant_get("item", f"$.{k}", "string")) for k in ("family", "signal", "name", "pattern")]
    name = F.when(_kind(F.col("item")) == "text", F.try_variant_get("item", "$", "string")).when(_kind(F.col("item")) == "map", F.coalesce(*inner))
    return rows.select("scope", "proposal", "place", name.alias("name")).where(F.col("name").isNotNull())


def proposed_signals(proposals: DataFrame) -> DataFrame:
    """(scope, item): known signals that proposals name."""
    key = F.regexp_replace(F.lower(F.trim("name")), "[- ]", "_")
    known = proposals.sparkSession.createDataFrame(list(SIGNAL_ALIASES.items()), "key string, item string")
    return named(proposals, "allowed_signals").select("scope", key.alias("key")).where(~F.col("key").rlike(DENIED)).join(F.broadcast(known), "key").select("scope", "item").distinct()


def proposed_families(proposals: DataFrame) -> DataFrame:
    """(scope, item, place): family names with other characters as one dash, by their first appearance."""
    name = F.regexp_replace(F.regexp_replace(F.trim("name"), r"[^0-9A-Za-z_\-]+", "-"), "^-+|-+$", "")
    rows = named(proposals, "preferred_families").select("scope", name.alias("item"), F.struct("proposal", "place").alias("place"))
    return rows.where((F.col("item") != "") & ~F.col("item").rlike(DENIED)).groupBy("scope", "item").agg(F.min("place").alias("place"))


def proposed_forbidden(proposals: DataFrame) -> DataFrame:
    """(scope, item): forbidden patterns that proposals mean."""
    rules = F.array(*[F.when(F.lower("name").rlike(f"(?s){k}"), v) for k, v in FORBIDDING.items()])
    return named(proposals, "forbidden_patterns").select("scope", F.explode(F.array_compact(rules)).alias("item")).distinct()


def _entries(proposals: DataFrame, field: str) -> DataFrame:
    return proposals.select("scope", "proposal", F.posexplode(F.map_entries(F.try_variant_get("policy", f"$.{field}", "map<string,variant>"))).alias("place", "e")).select("scope", "proposal", "place", F.col("e.key").alias("key"), F.col("e.value").alias("v"))


def _latest(rows: DataFrame) -> DataFrame:
    """(scope, item, value): the last word on each item counts."""
    return rows.groupBy("scope", "item").agg(F.max_by("value", F.struct("proposal", "place")).alias("value"))


def proposed_caps(proposals: DataFrame) -> DataFrame:
    """(scope, item, value): scalars and null as they are, lists of at most MOST_ITEMS scalars, maps of scalars and lists."""
    rows = _entries(proposals, "cap_bounds").withColumn("kind", _kind(F.col("v"))).withColumn("item", _safe(F.col("key")))
    plain = F.slice(F.filter(F.try_variant_get("v", "$", "array<variant>"), _scalar), 1, MOST_ITEMS)
    fields = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda _, x: _scalar(x) | (_kind(x) == "list"))
    fields = F.transform(F.map_entries(fields), lambda e: F.struct(F.regexp_replace(e["key"], r"[^0-9A-Za-z_\-]+", "_").alias("key"), e["value"].alias("value")))
    names = F.transform(fields, lambda e: e["key"])
    fields = F.map_from_entries(F.filter(fields, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])))  # the last of equal keys
    value = F.when(F.col("kind") == "list", F.when(F.size(plain) > 0, F.to_json(plain))).when(F.col("kind") == "map", F.when(F.size(fields) > 0, F.to_json(fields))).otherwise(F.to_json("v"))
    return _latest(rows.withColumn("value", F.coalesce(value, F.when(F.col("kind") == "nothing", "null"))).where((F.col("item") != "") & F.col("value").isNotNull()))


def proposed_updates(proposals: DataFrame) -> DataFrame:
    """(scope, item, value): scalars under the keys that proposals may set."""
    rows = _entries(proposals, "update_bounds").where(F.col("key").isin(*UPDATE_KEYS) & _scalar(F.col("v")))
    return _latest(rows.select("scope", "proposal", "place", F.col("key").alias("item"), F.to_json("v").alias("value")))


def bound_policies(statistics: DataFrame, proposals: DataFrame) -> DataFrame:
    """Items of the policy of every scope of ``statistics`` (scope, families ARRAY, runtime_cap).

    ``proposals`` has scope, proposal (its number within the scope, from 1) and policy (JSON text; what is none
    proposes nothing). The first MOST_PROPOSALS of a scope count. Families are the statistics' own, ``unknown`` aside,
    or NO_FAMILY, then the proposed ones, MOST_FAMILIES in all. What is always forbidden, allowed or fixed stays so.
    """
    parsed = proposals.where(F.col("proposal") <= MOST_PROPOSALS).select("scope", "proposal", F.try_parse_json("policy").alias("policy")).join(statistics.select("scope"), "scope", "left_semi")
    scopes = statistics.select("scope")
    text = lambda part, items: scopes.select("scope", F.lit(part).alias("part"), F.explode(F.array(*map(F.lit, items))).alias("item"), F.lit(None).cast("string").alias("value"))
    pair = lambda part, items: scopes.select("scope", F.lit(part).alias("part"), F.explode(F.create_map(*[F.lit(x) for kv in items.items() for x in kv])).alias("item", "value"))
    none = F.lit(None).cast("string").alias("value")
    own = F.filter("families", lambda f: f.isNotNull() & (f != "") & (f != "unknown"))
    own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(NO_FAMILY)))
    seen = statistics.select("scope", F.posexplode(own).alias("place", "item")).groupBy("scope", "item").agg(F.min(F.struct(F.lit(0).alias("proposal"), "place")).alias("place"))
    families = seen.unionByName(proposed_families(parsed)).groupBy("scope", "item").agg(F.min("place").alias("place"))
    families = families.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy("place"))).where(F.col("place") <= MOST_FAMILIES)
    signals = text("signal", sorted({*BASE_SIGNALS, *ALWAYS_ALLOWED})).unionByName(proposed_signals(parsed).select("scope", F.lit("signal").alias("part"), "item", none)).distinct()
    forbidden = text("forbidden", ALWAYS_FORBIDDEN).unionByName(proposed_forbidden(parsed).select("scope", F.lit("forbidden").alias("part"), "item", none)).distinct()
    contract = "{" + ",".join(f'"{b}":{{' + ",".join(f'"{k}":{v}' for k, v in caps.items()) + "}" for b, caps in BRANCH_CAPS.items()) + "}"
    fixed = FIXED_CAPS | {"target_family_cap_contract": contract.replace(" ", "")}
    runtime = statistics.select("scope", F.lit("cap").alias("part"), F.lit("max_candidate_runtime_s_on_proxy").alias("item"), F.col("runtime_cap").cast("string").alias("value"))

    def settled(part: str, base: DataFrame, proposed: DataFrame, held: dict[str, str]) -> DataFrame:
        said = proposed.where(~F.col("item").isin(*held)).select("scope", F.lit(part).alias("part"), "item", "value")
        return base.join(said, ["scope", "item"], "left_anti").unionByName(said).unionByName(pair(part, held))

    caps = settled("cap", pair("cap", BASE_CAPS).unionByName(runtime), proposed_caps(parsed), fixed)
    updates = settled("update", pair("update", BASE_UPDATES), proposed_updates(parsed), FIXED_UPDATES)
    whole = families.select("scope", F.lit("family").alias("part"), "item", none, "place")
    for part in (text("pruned", PRUNED), signals, forbidden, caps, updates):
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
