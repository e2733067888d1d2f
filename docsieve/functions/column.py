"""The column plane: a query on one value of known type, as a Column.

Lists are arrays under higher-order functions, maps are structs or maps. Nothing
here moves rows, so it runs inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..plans import ast as A
from . import scalars as S
from .scalars import Val, kind


def _bound(values: list[Column], f) -> Column:
    """``f`` of values that are computed once, however often it uses them."""
    row = F.array(F.struct(*(x.alias(f"x{i}") for i, x in enumerate(values))))
    return F.get(F.transform(row, lambda s: f(*(s[f"x{i}"] for i in range(len(values))))), 0)


class Columns:
    """Compiles nodes against a context value."""

    def __init__(self, strict: bool = True):
        self.strict = strict

    def value(self, node: A.Node, ctx: Val) -> Val:
        match node:
            case A.Identity():
                return ctx
            case A.Field(name):
                return self.field(ctx, name)
            case A.Literal(value):
                return S.literal(value)
            case A.Access(target, name):
                return self.field(self.value(target, ctx), name)
            case A.Index(target, index):
                return self.index(self.value(target, ctx), index, ctx)
            case A.Slice(target, start, end):
                return self.slice(self.value(target, ctx), *(None if x is None else self.value(x, ctx) for x in (start, end)))
            case A.Pipe(left, right):
                return self.piped(self.value(left, ctx), right)
            case A.Unary(op, operand):
                return S.unary(op, self.value(operand, ctx), self.strict)
            case A.Binary(op, left, right):
                return S.binary(op, self.value(left, ctx), self.value(right, ctx), self.strict)
            case A.If(condition, then, otherwise):
                return S.conditional(self.value(condition, ctx), self.value(then, ctx), self.value(otherwise, ctx), self.strict)
            case A.Text(parts):
                return Val(F.concat(*(F.lit(p) if isinstance(p, str) else S.rendered(self.value(p, ctx)) for p in parts)), T.StringType())
            case A.Object(entries):
                fields = {k: self.value(v, ctx) for k, v in entries}
                return Val(None, T.StructType([T.StructField(k, v.type) for k, v in fields.items()]), fields)
        raise QueryError(f"cannot plan {node!r}")

    def piped(self, left: Val, right: A.Node) -> Val:
        if kind(left.type) == "null":
            return left
        out = self.operation(right, left) if isinstance(right, A.Op) else self.value(right, left)
        if left.fields is not None or kind(out.type) == "null":
            return out
        if isinstance(right, (A.Identity, A.Field)):
            return out  # absence passes through anyway
        return Val(F.when(left.col.isNotNull(), out.column()), out.type)

    # navigation

    def field(self, v: Val, name: str) -> Val:
        if v.fields is not None:
            return v.fields.get(name, S.null())
        t = v.type
        if isinstance(t, T.NullType):
            return v
        if isinstance(t, T.StructType):
            return Val(v.col.getField(name), t[name].dataType) if name in t.names else S.null()
        if isinstance(t, T.MapType):
            return Val(F.try_element_at(v.col, F.lit(name)), t.valueType)
        if isinstance(t, T.VariantType):
            return Val(F.try_variant_get(v.col, f"$['{name}']", "variant"), t)
        raise QueryError(f'cannot read field "{name}" of {kind(t)}')

    def index(self, v: Val, index: A.Node, ctx: Val) -> Val:
        if kind(v.type) == "null":
            return v
        i = self.value(index, ctx)
        if isinstance(v.type, T.ArrayType):
            if kind(i.type) != "number":
                raise S.type_error("index", "number", i)
            k = S.checked(i, "index", self.strict).cast("int")
            return Val(F.get(v.col, F.when(k < 0, k + F.size(v.col)).otherwise(k)), v.type.elementType)
        if kind(v.type) == "map":
            if kind(i.type) != "string":
                raise S.type_error("index", "string", i)
            if isinstance(index, A.Literal):
                return self.field(v, index.value)
            if isinstance(v.type, T.MapType):
                return Val(F.try_element_at(v.col, i.col), v.type.valueType)
            m = self.as_map(v, "index")
            return Val(F.try_element_at(m.col, i.col), m.type.valueType)
        raise QueryError(f"cannot index {kind(v.type)}")

    def slice(self, v: Val, start: Val | None, end: Val | None) -> Val:
        if kind(v.type) == "null":
            return v
        if kind(v.type) not in ("list", "string"):
            raise S.type_error("slice", "list or string", v)
        for b in (start, end):
            if b is not None and kind(b.type) != "number":
                raise S.type_error("slice", "number", b)
        is_list = kind(v.type) == "list"
        raw = v.col if is_list else F.encode(v.col, "UTF-16LE")
        n = F.size(raw) if is_list else (F.length(raw) / 2).cast("int")

        def bound(b: Val | None, default: Column) -> Column:
            if b is None:
                return default
            k = S.checked(b, "slice", self.strict).cast("int")
            return F.greatest(F.lit(0), F.least(n, F.when(k < 0, k + n).otherwise(k)))

        s, e = bound(start, F.lit(0)), bound(end, n)
        size = F.greatest(F.lit(0), e - s)
        if is_list:
            return Val(F.slice(v.col, s + 1, size), v.type)
        return Val(F.decode(F.substring(raw, s * 2 + 1, size * 2), "UTF-16LE"), T.StringType())

    # operations

    def operation(self, op: A.Op, v: Val) -> Val:
        return getattr(self, f"op_{op.name}")(v, *([] if op.arg is None else [op.arg]))

    def list_(self, op: str, v: Val) -> tuple[Column, T.DataType]:
        if not isinstance(v.type, T.ArrayType):
            raise S.type_error(op, "list", v)
        return v.col, v.type.elementType

    def as_map(self, v: Val, op: str) -> Val:
        """A struct as a map of one value type (variant if they differ)."""
        if isinstance(v.type, T.MapType):
            return v
        if not isinstance(v.type, T.StructType):
            raise S.type_error(op, "map", v)
        fields = {n: self.field(v, n) for n in v.type.names}
        t: T.DataType = T.NullType()
        for x in fields.values():
            t = S.unified(Val(None, t), x)
        values = [S.to_variant(x) if isinstance(t, T.VariantType) else x.column().cast(t) for x in fields.values()]
        col = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*values)) if fields else F.map_from_arrays(F.array().cast("array<string>"), F.array())
        return Val(col, T.MapType(T.StringType(), t))

    def op_filter(self, v: Val, p: A.Node) -> Val:
        a, t = self.list_("filter", v)

        def test(x: Column) -> Column:
            out = self.value(p, Val(x, t))
            return F.coalesce(out.col, F.lit(False)) if kind(out.type) == "boolean" else F.lit(False)

        return Val(F.filter(a, test), v.type)

    def op_map(self, v: Val, e: A.Node) -> Val:
        a, t = self.list_("map", v)
        out = self.value(e, Val(F.lit(None).cast(t), t)).type  # the type doesn't depend on the column
        return Val(F.transform(a, lambda x: self.value(e, Val(x, t)).column()), T.ArrayType(out))

    def _comparable(self, op: str, a: Column, t: T.DataType) -> Column:
        if kind(t) not in ("number", "string", "time", "null"):
            raise QueryError(f"{op}: cannot compare {kind(t)}")
        if not self.strict:
            return a
        return F.when((F.size(a) > 1) & F.exists(a, lambda x: x.isNull()), F.raise_error(F.lit(f"{op}: got null")).cast(T.ArrayType(t))).otherwise(a)

    def op_sort(self, v: Val) -> Val:
        a, t = self.list_("sort", v)
        return Val(F.array_sort(self._comparable("sort", a, t)), v.type)

    def op_sort_by(self, v: Val, k: A.Node) -> Val:
        a, t = self.list_("sort_by", v)
        kt = self.value(k, Val(F.lit(None).cast(t), t)).type
        keys = self._comparable("sort_by", F.transform(a, lambda x: self.value(k, Val(x, t)).column()), kt)
        placed = F.array_sort(F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return Val(F.transform(placed, lambda q: F.get(a, q["i"])), v.type)

    def op_reverse(self, v: Val) -> Val:
        return Val(F.reverse(self.list_("reverse", v)[0]), v.type)

    def _keys(self, op: str, v: Val, k: A.Node | None) -> tuple[Column, T.DataType, Column, T.DataType]:
        a, t = self.list_(op, v)
        if k is None:
            return a, t, F.transform(a, lambda x: F.struct(self._key(Val(x, t)).alias("k"))), t
        kt = self.value(k, Val(F.lit(None).cast(t), t)).type
        return a, t, F.transform(a, lambda x: F.struct(self._key(self.value(k, Val(x, t))).alias("k"))), kt

    def _key(self, v: Val) -> Column:
        """Maps aren't comparable in Spark; their sorted entries are."""
        return F.array_sort(F.map_entries(v.col)) if isinstance(v.type, T.MapType) else v.column()

    def _runs(self, a: Column, keys: Column, made) -> Column:
        """``made(a, runs)``, where a run lists the places of one key, and runs come in the order of their first.

        One sort by key and place, then a look at each one's neighbour: n log n."""
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k["k"].alias("k"), i.alias("i"))))

        def begins(s: Column) -> Column:
            return F.filter(F.transform(s, lambda x, j: F.when((j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(x["k"]), j)), lambda j: j.isNotNull())

        def runs(s: Column, b: Column) -> Column:
            return F.array_sort(F.transform(b, lambda p, g: F.slice(s, p + 1, F.coalesce(F.get(b, g + 1), F.size(s)) - p)["i"]))

        out = _bound([placed], lambda s: _bound([s, begins(s)], runs))
        return F.when(a.isNotNull(), _bound([a, out], made))

    def op_group_by(self, v: Val, k: A.Node) -> Val:
        a, t, keys, kt = self._keys("group_by", v, k)

        def made(a: Column, runs: Column) -> Column:
            return F.transform(
                runs,
                lambda r: F.struct(self.value(k, Val(F.get(a, F.get(r, 0)), t)).column().alias("key"), F.transform(r, lambda i: F.get(a, i)).alias("values")),
            )

        return Val(self._runs(a, keys, made), T.ArrayType(T.StructType([T.StructField("key", kt), T.StructField("values", v.type)])))

    def op_unique(self, v: Val) -> Val:
        return self._firsts("unique", v, None)

    def op_unique_by(self, v: Val, k: A.Node) -> Val:
        return self._firsts("unique_by", v, k)

    def _firsts(self, op: str, v: Val, k: A.Node | None) -> Val:
        a, _, keys, _ = self._keys(op, v, k)
        if k is None and kind(v.type.elementType) not in ("map", "list"):
            return Val(F.array_distinct(a), v.type)
        return Val(self._runs(a, keys, lambda a, runs: F.transform(runs, lambda r: F.get(a, F.get(r, 0)))), v.type)

    def op_flatten(self, v: Val) -> Val:
        a, t = self.list_("flatten", v)
        if not isinstance(t, T.ArrayType):
            return v
        return Val(F.flatten(F.transform(a, lambda x: F.coalesce(x, F.array(F.lit(None).cast(t.elementType))))), t)

    def op_keys(self, v: Val) -> Val:
        t = T.ArrayType(T.StringType())
        if isinstance(v.type, T.ArrayType):
            n = F.size(v.col)
            return Val(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).cast("array<bigint>"), T.ArrayType(T.LongType()))
        if isinstance(v.type, T.StructType):
            return Val(F.array(*map(F.lit, v.type.names)).cast(t), t)
        return Val(F.map_keys(self.as_map(v, "keys").col), t)

    def op_values(self, v: Val) -> Val:
        if isinstance(v.type, T.ArrayType):
            return v
        m = self.as_map(v, "values")
        return Val(F.map_values(m.col), T.ArrayType(m.type.valueType))

    def op_length(self, v: Val) -> Val:
        if isinstance(v.type, T.StructType):
            return S.literal(len(v.type.names))
        if kind(v.type) not in ("list", "map", "string"):
            raise S.type_error("length", "list, map or string", v)
        return Val(S.units(v.col) if kind(v.type) == "string" else F.size(v.col).cast("long"), T.LongType())

    def op_first(self, v: Val) -> Val:
        a, t = self.list_("first", v)
        return Val(F.get(a, F.lit(0)), t)

    def op_last(self, v: Val) -> Val:
        a, t = self.list_("last", v)
        return Val(F.try_element_at(a, F.lit(-1)), t)

    def _fold(self, op: str, v: Val) -> tuple[Column, T.DataType]:
        a, t = self.list_(op, v)
        if kind(t) not in ("number", "null"):
            raise S.type_error(op, "number", Val(None, t))
        t = T.LongType() if S.is_int(t) or kind(t) == "null" else T.DoubleType()
        add = F.aggregate(a, F.lit(0).cast(t), lambda s, x: s + S.checked(Val(x, v.type.elementType), op, self.strict).cast(t))
        return add, t

    def op_sum(self, v: Val) -> Val:
        return Val(*self._fold("sum", v))

    def op_avg(self, v: Val) -> Val:
        total, _ = self._fold("avg", v)
        n = F.size(v.col)
        return Val(F.when(n == 0, F.raise_error(F.lit("avg: empty list")).cast("double")).otherwise(total.cast("double") / F.when(n > 0, n)), T.DoubleType())

    def _best(self, op: str, v: Val) -> Val:
        a, t = self.list_(op, v)
        a = self._comparable(op, a, t)
        best = F.array_min(a) if op == "min" else F.array_max(a)
        return Val(F.when(F.size(v.col) == 0, F.raise_error(F.lit(f"{op}: empty list")).cast(t)).otherwise(best), t)

    def op_min(self, v: Val) -> Val:
        return self._best("min", v)

    def op_max(self, v: Val) -> Val:
        return self._best("max", v)

    def op_has(self, v: Val, k: A.Node) -> Val:
        key = self.value(k, v)
        if isinstance(v.type, T.ArrayType) and kind(key.type) == "number":
            return Val((key.col >= 0) & (key.col < F.size(v.col)), T.BooleanType())
        if kind(v.type) == "map" and kind(key.type) == "string":
            if isinstance(v.type, T.MapType):
                return Val(F.map_contains_key(v.col, key.col), T.BooleanType())
            return Val(key.col.isin(v.type.names), T.BooleanType())
        raise QueryError(f"has: cannot look up {kind(key.type)} in {kind(v.type)}")

    def op_to_entries(self, v: Val) -> Val:
        m = self.as_map(v, "to_entries")
        t = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", m.type.valueType)])
        return Val(F.map_entries(m.col), T.ArrayType(t))

    def op_from_entries(self, v: Val) -> Val:
        a, t = self.list_("from_entries", v)
        if not isinstance(t, T.StructType) or "key" not in t.names or kind(t["key"].dataType) != "string":
            raise QueryError("from_entries: expected entries with a string key")
        value = t["value"].dataType if "value" in t.names else T.NullType()
        a = F.filter(a, lambda x: x.isNotNull())
        keys = F.transform(a, lambda x: F.struct(S.checked(Val(x["key"], T.StringType()), "from_entries", True).alias("k")))

        def made(a: Column, runs: Column) -> Column:  # of equal keys the last value, at the place of the first
            last = F.transform(runs, lambda r: F.get(a, F.element_at(r, -1))["value"] if "value" in t.names else F.lit(None))
            return F.map_from_arrays(F.transform(runs, lambda r: F.get(a, F.get(r, 0))["key"]), last)

        return Val(self._runs(a, keys, made), T.MapType(T.StringType(), value))

    def op_filter_values(self, v: Val, p: A.Node) -> Val:
        m = self.as_map(v, "filter_values")
        return Val(F.map_filter(m.col, lambda k, x: self._true(p, Val(x, m.type.valueType))), m.type)

    def op_filter_keys(self, v: Val, p: A.Node) -> Val:
        m = self.as_map(v, "filter_keys")
        return Val(F.map_filter(m.col, lambda k, x: self._true(p, Val(k, T.StringType()))), m.type)

    def _true(self, p: A.Node, v: Val) -> Column:
        out = self.value(p, v)
        return F.coalesce(out.col, F.lit(False)) if kind(out.type) == "boolean" else F.lit(False)

    def op_map_values(self, v: Val, e: A.Node) -> Val:
        if isinstance(v.type, T.StructType):
            fields = {n: self.value(e, self.field(v, n)) for n in v.type.names}
            return Val(None, T.StructType([T.StructField(n, x.type) for n, x in fields.items()]), fields)
        m = self.as_map(v, "map_values")
        t = self.value(e, Val(F.lit(None).cast(m.type.valueType), m.type.valueType)).type
        return Val(F.transform_values(m.col, lambda k, x: self.value(e, Val(x, m.type.valueType)).column()), T.MapType(T.StringType(), t))
