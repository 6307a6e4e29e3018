"""Column names that clash with no other."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as it takes to be new (case aside)."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
