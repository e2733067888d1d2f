"""Typed scalar kernels: Column expressions that keep the language's rules under Catalyst.

Spark coerces, propagates null and raises on division by zero; the language
doesn't. Kinds are checked when a query is planned, and nulls by a guard that
raises only where a row really has one (``strict``), so that all stays inside
whole-stage code generation."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EvalError, QueryError

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTS, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Val:
    """A column with its type. A row that isn't a column yet has its fields instead; a number from the query's text is known."""

    col: Column | None
    type: T.DataType
    fields: dict | None = None
    known: float | None = None

    def column(self) -> Column:
        if self.fields is None:
            return self.col
        if not self.fields:
            return F.struct()
        return F.struct(*(v.column().alias(k) for k, v in self.fields.items()))


def kind(t: T.DataType) -> str:
    for name, types in (
        ("null", T.NullType), ("boolean", T.BooleanType), ("number", NUMBERS), ("string", (T.StringType, T.CharType, T.VarcharType)),
        ("list", T.ArrayType), ("map", (T.MapType, T.StructType)), ("time", (T.TimestampType, T.TimestampNTZType, T.DateType)),
    ):
        if isinstance(t, types):
            return name
    return t.simpleString()


def is_int(t: T.DataType) -> bool:
    return isinstance(t, INTS)


def null() -> Val:
    return Val(F.lit(None), T.NullType())


def literal(value) -> Val:
    if value is None:
        return null()
    t = T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.DoubleType() if isinstance(value, float) else T.StringType()
    return Val(F.lit(value).cast(t), t, known=None if isinstance(value, (bool, str)) else value)


def checked(v: Val, op: str, strict: bool) -> Column:
    """The column; where it is null, the row raises."""
    if not strict:
        return v.col
    return F.when(v.col.isNull(), F.raise_error(F.lit(f"{op}: got null")).cast(v.type)).otherwise(v.col)


def need(v: Val, op: str, *kinds: str) -> None:
    if kind(v.type) not in kinds:
        raise EvalError(f"{op}: expected {' or '.join(kinds)}, got {kind(v.type)}")


def arithmetic(op: str, a: Val, b: Val, strict: bool) -> Val:
    if op == "+" and kind(a.type) == kind(b.type) == "string":
        return Val(F.concat(checked(a, op, strict), checked(b, op, strict)), T.StringType())
    need(a, op, "number")
    need(b, op, "number")
    whole = is_int(a.type) and is_int(b.type) and op != "/"
    t = T.LongType() if whole else T.DoubleType()
    x, y = (checked(v, op, strict).cast(t) for v in (a, b))
    if op == "/":
        inf = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return Val(F.when(y == 0, inf).otherwise(x / F.when(y != 0, y)), t)
    if op == "%":
        zero = F.lit(float("nan"))
        rest = F.pmod(x, F.abs(F.when(y != 0, y)))
        return Val(F.when(y == 0, zero).otherwise(rest.cast("double")), T.DoubleType()) if not whole or not b.known else Val(F.pmod(x, F.abs(y)), t)
    return Val({"+": x + y, "-": x - y, "*": x * y}[op], t)


def order(op: str, a: Val, b: Val, strict: bool) -> Val:
    if not (kind(a.type) == kind(b.type) and kind(a.type) in ("number", "time")):
        raise EvalError(f"{op}: cannot compare {kind(a.type)} with {kind(b.type)}")
    x, y = checked(a, op, strict), checked(b, op, strict)
    return Val({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], T.BooleanType())


def equal(a: Val, b: Val) -> Column:
    """Deep equality that is never null; NaN equals nothing."""
    ka, kb = kind(a.type), kind(b.type)
    if "null" in (ka, kb):
        return (a if kb == "null" else b).column().isNull() if ka != kb else F.lit(True)
    if ka != kb:
        return a.column().isNull() & b.column().isNull()
    x, y = a.column(), b.column()
    if ka == "number":
        same = x.eqNullSafe(y)
        return same & ~F.coalesce(F.isnan(x.cast("double")), F.lit(False)) if not (is_int(a.type) and is_int(b.type)) else same
    if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        if set(a.type.names) != set(b.type.names):
            return x.isNull() & y.isNull()
        each = [equal(Val(x.getField(n), a.type[n].dataType), Val(y.getField(n), b.type[n].dataType)) for n in a.type.names]
        return reduce(lambda p, q: p & q, each, x.isNull().eqNullSafe(y.isNull()))
    if isinstance(a.type, T.MapType) and isinstance(b.type, T.MapType):
        return F.array_sort(F.map_entries(x)).eqNullSafe(F.array_sort(F.map_entries(y)))
    if ka == "list" and kind(a.type.elementType) in ("list", "map"):
        pairs = F.zip_with(x, y, lambda p, q: equal(Val(p, a.type.elementType), Val(q, b.type.elementType)))
        return F.coalesce((F.size(x) == F.size(y)) & F.forall(pairs, lambda p: p), x.isNull() & y.isNull())
    return x.eqNullSafe(y)


def logic(op: str, a: Val, b: Val, strict: bool) -> Val:
    need(a, op, "boolean")
    need(b, op, "boolean")
    x, y = checked(a, op, strict), checked(b, op, strict)
    return Val(x & y if op == "&&" else x | y, T.BooleanType())


def binary(op: str, a: Val, b: Val, strict: bool) -> Val:
    if op in ("==", "!="):
        same = equal(a, b)
        return Val(same if op == "==" else ~same, T.BooleanType())
    if op in ("&&", "||"):
        return logic(op, a, b, strict)
    return arithmetic(op, a, b, strict) if op in "+-*/%" else order(op, a, b, strict)


def unary(op: str, v: Val, strict: bool) -> Val:
    need(v, op, "number" if op == "-" else "boolean")
    x = checked(v, op, strict)
    return Val(-x if op == "-" else ~x, v.type, known=None if v.known is None else -v.known)


def unified(a: Val, b: Val) -> T.DataType:
    """The type of a value that is one or the other."""
    ka, kb = kind(a.type), kind(b.type)
    if ka == "null" or kb == "null":
        return b.type if ka == "null" else a.type
    if a.type == b.type:
        return a.type
    if ka == kb == "number":
        return T.LongType() if is_int(a.type) and is_int(b.type) else T.DoubleType()
    if ka == kb and ka in ("string", "time"):
        return a.type
    return T.VariantType()


def to_variant(v: Val) -> Column:
    if isinstance(v.type, T.VariantType):
        return v.col
    if kind(v.type) == "map" or kind(v.type) == "list":
        return F.parse_json(F.to_json(v.column(), {"ignoreNullFields": "false"}))
    return v.column().cast("variant")


def conditional(c: Val, a: Val, b: Val, strict: bool) -> Val:
    need(c, "if", "boolean")
    t = unified(a, b)
    x, y = (to_variant(v) if isinstance(t, T.VariantType) else v.column().cast(t) for v in (a, b))
    return Val(F.when(checked(c, "if", strict), x).otherwise(y), t)


def rendered(v: Val) -> Column:
    """A value as interpolation shows it."""
    k = kind(v.type)
    if k == "null":
        return F.lit("null")
    x = v.column()
    if k == "number" and not is_int(v.type) and not isinstance(v.type, T.DecimalType):
        d = x.cast("double")
        digits = F.regexp_replace(F.format_string("%.0f", d), r"$", ".0")
        short = F.regexp_replace(F.regexp_replace(d.cast("string"), r"\.0E", "E"), "E(-?)", "e$1")
        out = (
            F.when(F.isnan(d), "NaN").when(d == float("inf"), "Infinity").when(d == float("-inf"), "-Infinity")
            .when((d == F.floor(d).cast("double")) & (F.abs(d) < 1e15), digits).when(F.abs(d) >= 1e21, F.regexp_replace(short, "e", "e+")).otherwise(short)
        )
    elif isinstance(v.type, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: rendered(Val(e, v.type.elementType))), ", "), F.lit("]"))
    elif isinstance(v.type, T.StructType):
        parts = [F.concat(F.lit(f"{n}: "), rendered(Val(x.getField(n), v.type[n].dataType))) for n in v.type.names]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(v.type, T.MapType):
        each = F.transform(F.map_entries(x), lambda e: F.concat(e["key"], F.lit(": "), rendered(Val(e["value"], v.type.valueType))))
        out = F.concat(F.lit("{"), F.array_join(each, ", "), F.lit("}"))
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit("null"))


def units(x: Column) -> Column:
    """Length of a string in UTF-16 code units."""
    return (F.length(F.encode(x, "UTF-16LE")) / 2).cast("long")


def schema_text(t: T.DataType):
    """Names of kinds, shaped like the type."""
    if isinstance(t, T.StructType):
        return {f.name: schema_text(f.dataType) for f in t.fields}
    if isinstance(t, T.ArrayType):
        return [] if isinstance(t.elementType, T.NullType) else [schema_text(t.elementType)]
    if isinstance(t, T.MapType):
        return {"*": schema_text(t.valueType)}
    return kind(t)


def type_error(op: str, wanted: str, v: Val) -> QueryError:
    return QueryError(f"{op}: expected {wanted}, got {kind(v.type)}")


def describe(t: T.DataType) -> str:
    return json.dumps(schema_text(t))
