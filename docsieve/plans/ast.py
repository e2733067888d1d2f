"""Nodes of a query. Pipeline operations share ``Op``; their names are in OPS."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed names of operations: with an argument, and without.
WITH_ARG = ("filter_values", "filter_keys", "filter", "map_values", "map", "sort_by", "group_by", "unique_by", "has")
BARE = ("sort", "unique", "flatten", "reverse", "keys", "values", "length", "first", "last", "sum", "avg", "min", "max", "to_entries", "from_entries")
OPS = WITH_ARG + BARE


class Node:
    """Any expression."""


@dataclass(frozen=True)
class Identity(Node):
    pass


@dataclass(frozen=True)
class Field(Node):
    name: str


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Access(Node):
    target: Node
    name: str


@dataclass(frozen=True)
class Index(Node):
    target: Node
    index: Node


@dataclass(frozen=True)
class Slice(Node):
    target: Node
    start: Node | None
    end: Node | None


@dataclass(frozen=True)
class Pipe(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class If(Node):
    condition: Node
    then: Node
    otherwise: Node


@dataclass(frozen=True)
class Text(Node):
    """A string with interpolated expressions; parts are str or Node."""

    parts: tuple


@dataclass(frozen=True)
class Object(Node):
    """Key and expression pairs, the last of equal keys only, at the first one's place."""

    entries: tuple


@dataclass(frozen=True)
class Op(Node):
    name: str
    arg: Node | None = None


def children(node: Node) -> list[Node]:
    out: list[Node] = []
    for v in vars(node).values():
        if isinstance(v, Node):
            out.append(v)
        elif isinstance(v, tuple):
            out += [y for x in v for y in (x if isinstance(x, tuple) else (x,)) if isinstance(y, Node)]
    return out
