"""Tables and documents in Spark: readers by format, and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import QueryError
from .formats import detect, dialect, parse


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None, row_tag: str = "row", header: bool | None = None) -> DataFrame:
    """A table: parquet, ORC, JSON (lines, or a list of rows), CSV, TSV or XML rows.

    CSV and TSV cells stay strings unless a schema is given; nothing is inferred by
    a pass over them. What parts the cells of a CSV and whether its first row names
    them is seen from the first lines (``header`` decides the latter if given).

    YAML, TOML, HCL and Markdown are whole documents, a file each: with a schema
    (of the document, or of the rows if it is a list) its rows or one row, else
    ``value``, a variant."""
    fmt = fmt or detect(path) or "parquet"
    r = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "parquet":
        return r.parquet(path)
    if fmt == "orc":
        return r.orc(path)
    if fmt in ("json", "jsonl"):
        return r.json(path, multiLine=fmt == "json")
    if fmt in ("csv", "tsv"):
        lines = "\n".join(x["value"] for x in spark.read.text(path).limit(20).collect())
        parted, named = dialect(lines)
        return r.csv(path, header=(named if fmt == "csv" else True) if header is None else header, sep=parted if fmt == "csv" else "\t", inferSchema=False)
    if fmt == "xml":
        return r.format("xml").option("rowTag", row_tag).load(path)
    return _whole(documents(spark, path), fmt, schema)


def _whole(files: DataFrame, fmt: str, schema: StructType | str | None) -> DataFrame:
    """The values of documents, parsed where the files lie."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(parse(t, fmt), ensure_ascii=False) for t in b.column(0).to_pylist()], pa.string())], names=["text"])

    text = files.select("text").mapInArrow(each, "text string")
    if schema is None:
        return text.select(F.parse_json("text").alias("value"))
    row = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>"
    return text.select(F.inline(F.from_json("text", f"array<{row}>", {"mode": "FAILFAST"})))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: path, text. For query_documents with any format."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """A distributed sink, a file for each task."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "orc":
        w.orc(path)
    elif fmt in ("json", "jsonl"):
        w.option("ignoreNullFields", "false").json(path)
    elif fmt in ("csv", "tsv"):
        w.csv(path, header=True, sep="," if fmt == "csv" else "\t")
    elif fmt == "xml":
        w.format("xml").option("rowTag", "row").save(path)
    else:
        raise QueryError(f"{fmt} is a document's format: docsieve.operators.documents.render gives one for each row")
