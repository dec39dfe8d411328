"""Operator trees as text."""

from __future__ import annotations

from ..types import name_of
from . import logical as L


def _line(op: L.Operator) -> str:
    side = lambda on: "on column" if on else "on key"
    match op:
        case L.Foreach():
            return "foreach: " + ", ".join(type(s).__name__ for s in op.systems)
        case L.Scan():
            return f"scan: {name_of(op.component)} ({op.columns[0].access})"
        case L.RefScan():
            return f"scan reference: {op.ref}"
        case L.Fetch():
            return f"fetch global: {name_of(op.component)} ({op.columns[0].access})"
        case L.TagFilter():
            return f"tag filter: {'has' if op.has else 'has not'} {op.tag}, {side(op.on_column)}"
        case L.ComponentFilter():
            return f"component filter: {'has' if op.has else 'has not'} {name_of(op.component)}, {side(op.on_column)}"
        case L.PredicateFilter():
            return f"predicate filter: {getattr(op.predicate, '__name__', 'function')}"
        case L.CascadingGather():
            return f"cascading gather: {op.ref}"
        case L.Gather():
            return f"gather: {op.ref}"
        case L.LeftFilterJoin():
            return "left filter join"
        case L.CrossJoin():
            return "cross join"
    return "join"


def tree(op: L.Operator, depth: int = 0) -> str:
    return "\n".join(["  " * depth + _line(op), *(tree(c, depth + 1) for c in op.children)])
