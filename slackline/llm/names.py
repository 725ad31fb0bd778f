"""Column names that clash with none of a caller's, whatever the case."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores behind it as make it new."""
    known, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out
