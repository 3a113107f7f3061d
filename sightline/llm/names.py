"""Names for the columns an operator adds for its own use."""

from __future__ import annotations

from collections.abc import Sequence


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as none of ``columns`` has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
