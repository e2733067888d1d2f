"""Queries over documents that are rows: one document a row, any structure.

Where documents share no schema, each is parsed and queried by the value
semantics in Arrow batches: no shuffle, and as many tasks as the scan has."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.values import run
from ..plans.ast import Node
from ..sources import formats, writers


def query_documents(node: Node, df: DataFrame, column: str, fmt: str | None = None, errors: str = "raise") -> DataFrame:
    """``df`` with ``value``: the result as JSON text (null if ``column`` is null).

    ``fmt`` None sniffs each text. With ``errors`` "keep", a failing document has
    a null value and its message in ``error``; else it ends the query. Columns of these
    names are replaced, as ``withColumn`` does."""

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return json.dumps(run(node, formats.parse(text, fmt or formats.sniff(text))), ensure_ascii=False, allow_nan=True), None
        except QueryError as e:
            if errors == "raise":
                raise
            return None, str(e)

    kept = [c for c in df.columns if c not in ("value", "error")]
    given = df.select(*("`" + c.replace("`", "``") + "`" for c in kept), F.col(column).cast("string").alias("value"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t) for t in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], names=[*kept, "value", "error"])

    return given.mapInArrow(each, T.StructType([*given.schema.fields[:-1], T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))


def render(df: DataFrame, fmt: str, name: str = "text") -> DataFrame:
    """``df`` with each row as a document's text in a format: a map, or for CSV and TSV a list of that map.

    The row's values are plain ones; times become text."""
    row = [c for c in df.columns if c != name]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [formats.plain({k: r[k] for k in row}) for r in b.to_pylist()]
            texts = [writers.write([r] if fmt in ("csv", "tsv") else r, fmt) for r in rows]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in row), pa.array(texts, pa.string())], names=[*row, name])

    given = df.select(*("`" + c.replace("`", "``") + "`" for c in row))
    return given.mapInArrow(each, T.StructType([*given.schema.fields, T.StructField(name, T.StringType())]))
