"""Errors of queries."""


class QueryError(Exception):
    """A query that can't be parsed, planned or applied to its input."""


class EvalError(QueryError):
    """Arithmetic, comparison or a condition on values of a wrong kind."""
