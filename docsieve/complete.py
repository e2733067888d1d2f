"""Completion of a query that is being typed.

What is to be completed becomes a hole in the text, and the parser stops at it. It
knows then what stands before the hole and inside of which operations it is, so
that names can be looked up in the data; nothing behind the hole is needed."""

from __future__ import annotations

import re

from .errors import QueryError
from .functions.values import run
from .plans.ast import OPS
from .plans.grammar import HOLE, Hole, until_hole
from .sources.writers import OUTPUTS

#: Fixed names of the interactive session's commands.
COMMANDS = ("help", "history", "load", "pretty", "q", "quit", "raw", "schema", "to")


def complete(text: str, cursor: int, data) -> tuple[int, list[str]]:
    """Where the word before the cursor begins, and what could stand there."""
    text = text[:cursor]
    if m := re.match(r":to\s+(\w*)\Z", text):
        return m.start(1), [f for f in sorted(OUTPUTS) if f.startswith(m[1])]
    if text.startswith(":"):
        return 1, [c for c in COMMANDS if c.startswith(text[1:])]
    if m := re.search(r"\.([A-Za-z_]\w*)?\Z", text):
        hole = until_hole(f"{text[: m.start()]}.{HOLE}")
        return m.start(), [f".{k}" for k in _names(hole, data) if k.startswith(m[1] or "")]
    if m := re.search(r"\|\s*([A-Za-z_]*)\Z", text):
        found = until_hole(text[: m.start(1)] + HOLE)
        return m.start(1), sorted(o for o in OPS if o.startswith(m[1])) if found else []
    return cursor, []


def _names(hole: Hole | None, data) -> list[str]:
    """Keys of the value before the hole."""
    if hole is None:
        return []
    try:
        v = data
        for left, op in hole.scopes:
            v = run(left, v)
            if op in ("filter_values", "map_values"):
                v = next(iter(v.values()), None) if isinstance(v, dict) else None
            elif op != "has":
                v = v[0] if isinstance(v, list) and v else None
        v = v if hole.target is None else run(hole.target, v)
    except QueryError:
        return []
    return sorted(v) if isinstance(v, dict) else []
