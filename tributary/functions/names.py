"""Names for helper columns that no column of the caller has."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *stems: str) -> list[str]:
    """The stems, each with as many underscores as make it differ from all that is taken, whatever the case."""
    used = {t.lower() for t in taken}
    out = []
    for name in stems:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
