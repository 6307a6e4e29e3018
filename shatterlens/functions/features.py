"""Features of program text: flags, families, signatures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal part that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def any_of(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


# Parts of program text that give each flag of the main rules.
MAIN_PARTS = {
    "degree_backbone": ("degree",), "frontier": ("frontier", "boundary"), "weak_tie": ("weak", "<= 2", "< 3"), "two_hop": ("two_hop", "2-hop"), "boundary": ("boundary",),
    "redundancy": ("redund", "clustering", "has_edge"), "phase": ("progress", "phase"), "heap_update": ("heapq", "heappush"), "component_refresh": ("connected_components",),
    "global_rescan": ("betweenness", "pagerank", "all_pairs"),
}
#: Calls of neighbors( from which a flag is set too.
MAIN_CALLS = {"frontier": 1, "two_hop": 2, "boundary": 2}
SIGNATURE = ("degree_backbone", "frontier", "weak_tie", "two_hop", "boundary", "redundancy", "phase", "heap_update")
# Regular expressions of the learned families' flags.
LEARNED_PATTERNS = {
    "heap_lazy_update": (r"heapq", r"heappush", r"heappop", r"version", r"stamp", r"push\("),
    "neighbor_degree": (r"deg\.get\(v", r"h\.degree\(v", r"degree\(v", r"neighbor.*degree", r"neigh[_a-z]*sum", r"nn_sum", r"avg_nb", r"nbr[_a-z]*deg", r"avg_nd", r"sum_nd"),
    "two_hop_exposure": (r"two[_ -]?hop", r"second[_a-z]*", r"neighbors\(w\)", r"for z in .*neighbors\(w\)", r"affected\.update", r"ex_sum", r"exposure", r"low2", r"s2"),
    "bridge_cut_signal": (r"bridge", r"bridge_pressure", r"cut", r"split", r"frontier", r"outside", r"external", r"escape", r"broker", r"articulation", r"leaf_cnt", r"low2_cnt"),
    "redundancy_penalty": (r"tri", r"cluster", r"redundan", r"internal_edges", r"has_edge"),
    "component_refresh": (r"connected_components", r"component", r"comp_size", r"gcc", r"largest"),
    "core_signal": (r"core_number", r"kcore", r"k_core", r"\bcore\b"),
    "global_expensive": (r"betweenness", r"shortest_path", r"all_pairs", r"eigen", r"pagerank", r"community", r"spectral"),
    "full_recompute_loop": (r"while .*number_of_nodes", r"max\(h\.nodes", r"for u in h\.nodes\(\)"),
}
FAMILIES = ("local_twohop_bridge", "local_twohop_neighbor", "bridge_core", "core_neighbor", "simple_degree", "component_heavy", "global_expensive")


def main_flags(code: Column) -> dict[str, Column]:
    """Flags of the main rules, ``unbounded_two_hop`` and ``neighbor_calls``."""
    text = F.lower(code)
    calls = count_of(text, "neighbors(")
    flags = {k: any_of(text, *parts) | (calls >= MAIN_CALLS[k] if k in MAIN_CALLS else F.lit(False)) for k, parts in MAIN_PARTS.items()}
    return flags | {"unbounded_two_hop": (calls >= 2) & ~any_of(text, "cap", "limit", "break"), "neighbor_calls": calls}


def main_family(code: Column, default: str = "other") -> Column:
    """Family by the first rule that holds."""
    text = F.lower(code)
    return (
        F.when(any_of(text, "connected_components"), "component-refresh").when(any_of(text, "two") | (count_of(text, "neighbors(") >= 2), "two-hop-boundary")
        .when(any_of(text, "clustering", "redund"), "redundancy-aware").when(any_of(text, "heapq"), "heap-local-update").when(any_of(text, "degree"), "degree-local").otherwise(default)
    )


def signature(flags: dict[str, Column], names: tuple[str, ...] = SIGNATURE, joint: str = "|", none: str = "plain", most: int | None = None) -> Column:
    """Names of the set flags, joined."""
    on = F.array_compact(F.array(*[F.when(flags[n], n) for n in names]))
    return F.coalesce(F.nullif(F.array_join(F.slice(on, 1, most) if most else on, joint), F.lit("")), F.lit(none))


def generic_signature(code: Column) -> Column:
    """Up to three coarse ideas of a program, joined by +."""
    text = F.lower(code)
    flags = {
        "heap": F.contains(code, F.lit("heap")), "core": any_of(text, "core"), "tri": any_of(text, "tri", "cluster"), "component": any_of(text, "component", "connected"),
        "neighbor": any_of(text, "neighbor", "nbr"), "twohop": any_of(text, "2") & any_of(text, "hop", "two"),
    }
    return signature(flags, tuple(flags), "+", "simple", 3)


def map_bin(code: Column) -> Column:
    """Archive niche: length, loops, first idea."""
    loops = count_of(code, "for ") + count_of(code, "while ")
    return F.concat_ws(":", F.when(F.length(code) < 1800, "short").otherwise("long"), F.when(loops < 7, "fewloops").otherwise("manyloops"), F.split(generic_signature(code), r"\+")[0])


def learned_flags(code: Column) -> dict[str, Column]:
    text = F.lower(F.coalesce(code, F.lit("")))
    return {k: text.rlike("|".join(p)) for k, p in LEARNED_PATTERNS.items()}


def learned_family(f: dict[str, Column]) -> Column:
    two, near, cut, core = f["two_hop_exposure"], f["neighbor_degree"], f["bridge_cut_signal"], f["core_signal"]
    return (
        F.when(f["global_expensive"], "global_expensive").when(f["component_refresh"] & ~(two & near), "component_heavy").when(two & cut, "local_twohop_bridge")
        .when(two & near, "local_twohop_neighbor").when(cut & core, "bridge_core").when(core & near, "core_neighbor").otherwise("simple_degree")
    )


def contract_violation(code: Column) -> Column:
    """Why a program breaks the static contract, '' if it does not."""
    flags, text = main_flags(code), F.lower(code)
    return (
        F.when(flags["global_rescan"], "global centrality").when(flags["component_refresh"], "component refresh")
        .when(flags["unbounded_two_hop"], "unbounded two-hop scan").when(any_of(text, "shortest_path", "all_pairs"), "path search").otherwise("")
    )


def experiment_flags(code: Column) -> dict[str, Column]:
    """Flags of the group experiments, which use other words."""
    text = F.lower(code)
    two, cap = any_of(text, "two", "2-hop", "single_source_shortest_path"), any_of(text, "cap", "limit", "[:", "break")
    return {
        "degree_backbone": any_of(text, "degree"), "frontier": any_of(text, "frontier", "neighbor", "boundary"), "weak_tie": any_of(text, "weak", "<= 2", "<=2", "low"), "boundary": any_of(text, "boundary") | two,
        "redundancy": any_of(text, "redundan", "cluster", "triangle", "overlap"), "phase": any_of(text, "phase", "progress", "len(order)"), "heap_update": any_of(text, "heap", "bucket"),
        "global_rescan": any_of(text, "connected_components", "core_number", "k_core"), "unbounded_two_hop": two & ~cap, "connected_components": any_of(text, "connected_components"),
    }
