"""Search policies as plug-ins: what to expand, what to show, what to ask, what to note.

A policy works on the records of all runs at once. ``noted`` adds the columns that the policy keeps of a record (its
clade, island or niche), ``select_parent`` gives one (run_id, node_id) of each run, ``examples`` the records shown with the prompt, and
``hint`` the sentence that goes into it. Policies are registered by name; a search takes any of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from shatterlens.operators import policies as po


@dataclass(frozen=True)
class SearchPolicy:
    """The greedy policy, and what others change: ``choose(records, seed)`` picks parents, ``note(records)`` adds columns."""

    name: str
    choose: Callable[[DataFrame, int], DataFrame] = lambda records, seed: po.top_pool(records, ["run_id"], 1)
    note: Callable[[DataFrame], DataFrame] = lambda records: records
    wish: str = "Give one change of the parent program."
    shown: int = 3

    def update(self, records: DataFrame) -> DataFrame:
        """The records with the policy's own columns."""
        return self.note(records)

    def select_parent(self, records: DataFrame, seed: int = 0) -> DataFrame:
        """(run_id, node_id): the record that each run expands next."""
        return self.choose(self.note(records), seed).select("run_id", "node_id")

    def examples(self, records: DataFrame) -> DataFrame:
        """(run_id, node_id, place): the best valid records of each run."""
        return po.top_pool(records, ["run_id"], self.shown).select("run_id", "node_id", "place")

    def hint(self, parents: DataFrame) -> DataFrame:
        """(run_id, node_id, hint) for the chosen parents."""
        return parents.select("run_id", "node_id", F.lit(self.wish).alias("hint"))


POLICIES: dict[str, SearchPolicy] = {}


def register(policy: SearchPolicy) -> None:
    """Add a policy; ValueError for a name that is taken."""
    if policy.name in POLICIES:
        raise ValueError(f"there is a policy {policy.name!r}")
    POLICIES[policy.name] = policy


def propose(records: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """(run_id, node_id, hint, examples ARRAY): what a policy would ask next in each run with a valid record."""
    policy = POLICIES[name]
    shown = policy.examples(records).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"]).alias("examples"))  # at most ``shown`` of a run
    return policy.hint(policy.select_parent(records, seed)).join(shown, "run_id", "left")


_islands = lambda records: records.withColumn("island", po.island_of(F.col("node_id")))
for _policy in (
    SearchPolicy("greedy"),
    SearchPolicy("exploring", lambda r, seed: po.uct_parent(r), wish="Explore a change that the best records lack."),
    SearchPolicy("clades", lambda r, seed: po.clade_parent(r, "family", seed), wish="Keep the idea of the parent's line and change it enough to found a family."),
    SearchPolicy("islands", lambda r, seed: po.island_parent(r, seed), _islands, "Write a short program of its own that joins ideas of the best."),
    SearchPolicy("niches", lambda r, seed: po.niche_parent(r, "family", seed), wish="Fill an empty niche with another structure and no needless code."),
    SearchPolicy("squares", lambda r, seed: po.squared_draw(r, ["run_id"], 8, seed), wish="Improve one of the eight best."),
):
    register(_policy)
