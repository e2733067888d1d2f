"""A query language over tables and documents, planned by Spark."""

from .api import Query, assert_query, compile, format_output, infer_schema, query, query_json, query_text
from .errors import EvalError, QueryError

__all__ = ["EvalError", "Query", "QueryError", "assert_query", "compile", "format_output", "infer_schema", "query", "query_json", "query_text"]
