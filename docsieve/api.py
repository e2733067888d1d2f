"""Entry points: queries on tables, on rows, on texts and on plain values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .errors import QueryError
from .functions import scalars, values
from .functions.column import Columns
from .operators.documents import query_documents as _documents
from .operators.relation import Relations, row_of
from .plans.ast import Node
from .plans.grammar import parse
from .sources import formats, writers


@dataclass(frozen=True)
class Query:
    """A parsed query, to be run many times."""

    text: str
    node: Node

    def on(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """The table is the list that the query works on; a frame of the resulting rows, or of one value."""
        return Relations(strict).run(self.node, df)

    def each(self, df: DataFrame, strict: bool = True, name: str = "value") -> DataFrame:
        """Each row is a document; ``df`` with the result beside it."""
        return df.withColumn(name, Columns(strict).value(self.node, row_of(df)).column())

    def documents(self, df: DataFrame, column: str, fmt: str | None = None, errors: str = "raise") -> DataFrame:
        """Each row's text is a document of any structure; adds value (JSON) and error."""
        return _documents(self.node, df, column, fmt, errors)

    def value(self, data):
        """The result on a plain value."""
        return values.run(self.node, data)


def compile(text: str) -> Query:  # noqa: A001
    return Query(text, parse(text).node)


def query(text: str, data, strict: bool = True):
    """On a DataFrame a DataFrame, on a plain value a value."""
    q = compile(text)
    return q.on(data, strict) if hasattr(data, "sparkSession") else q.value(data)


def query_text(text: str, source: str, fmt: str | None = None):
    """On a document's text; the format is guessed if it isn't given."""
    return compile(text).value(formats.parse(source, fmt or formats.sniff(source)))


def query_json(text: str, source: str):
    return query_text(text, source, "json")


def infer_schema(data):
    """Kinds in the shape of the data: from a frame's schema (a list of rows) or a plain value."""
    if hasattr(data, "schema"):
        return [scalars.schema_text(data.schema)]
    return values.schema_of(data)


def assert_query(text: str, data) -> bool:
    """Whether the query gives true; anything but a boolean raises."""
    out = query(text, data)
    if hasattr(out, "sparkSession"):
        rows = out.limit(2).collect()
        out = rows[0][0] if len(rows) == 1 and len(rows[0]) == 1 else None
    if not isinstance(out, bool):
        raise QueryError(f"assertion: expected a boolean, got {values.kind(out)}")
    return out


def format_output(value, fmt: str = "json", pretty: bool = True) -> str:
    return writers.write(value, fmt, pretty)


# three calls that a tool server can offer


def tool_query(data: str, expression: str, fmt: str | None = None) -> str:
    return writers.to_json(query_text(expression, data, fmt))


def tool_schema(data: str, fmt: str | None = None) -> str:
    return writers.to_json(values.schema_of(formats.parse(data, fmt or formats.sniff(data))))


def tool_assert(data: str, expression: str, fmt: str | None = None) -> str:
    out = query_text(expression, data, fmt)
    if not isinstance(out, bool):
        raise QueryError(f"assertion: expected a boolean, got {values.kind(out)}")
    return "PASS" if out else "FAIL"
