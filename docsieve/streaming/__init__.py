"""Queries on streams: stateless ones run on each row as it arrives.

The language has no streams, so only what needs no order and no end is taken:
``filter`` and ``map`` over a streaming frame, and ``each``. The plan is the same as
for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import QueryError
from ..operators.relation import Relations, table
from ..plans import ast as A
from ..plans.grammar import parse


def _stateless(node: A.Node) -> bool:
    match node:
        case A.Identity():
            return True
        case A.Pipe(left, A.Op("filter" | "map")):
            return _stateless(left)
    return False


def query_stream(text: str, df: DataFrame, strict: bool = True) -> DataFrame:
    """A streaming frame of the rows that the query lets through or makes."""
    node = parse(text).node
    if not _stateless(node):
        raise QueryError("a stream takes filter and map only")
    relations = Relations(strict)
    return relations.finish(relations.compile(node, table(df)))
