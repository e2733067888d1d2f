"""The relation plane: the list that a query works on is a DataFrame of elements.

Operations become DataFrame operators and Catalyst plans them. What the planner
here adds is what Catalyst can't know:

* ``group_by(K) | map({..})`` whose body only aggregates ``.values`` is one
  aggregation with map-side combine; no group is collected.
* several aggregates of one relation, as in ``{n: . | length, s: . | map(.x) | sum}``,
  are one pass.
* positions are made only if a later operation sees the order; ``reverse`` flips
  the order, and ``[:k]`` behind a sort becomes a top-k. ``[n:]`` and slices that begin
  or end far from the start sort by ranges, count the ranges and number the rows in them.
* a null guard hides a comparison from the scan, so filters also get the bare
  comparison "or null", which is pushed down.

A list that stands as a value inside another one, and the values of groups whose
body isn't an aggregate, are one row each; beyond ``LIST_ROWS`` rows they are refused
before they are gathered.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field, replace
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import scalars as S
from ..functions.column import Columns
from ..functions.scalars import Val, kind
from ..plans import ast as A

_numbers = count()
#: Rows that a list may have which must be one value.
LIST_ROWS = 1_000_000
#: Rows that a slice may reach from either end as a top-k; beyond it, rows are numbered by ranges.
TOP_ROWS = 100_000
#: Operations on a list of rows that give a list of rows.
LISTS = ("filter", "map", "sort", "sort_by", "reverse", "group_by", "unique", "unique_by", "flatten", "keys", "values")


def _fresh(name: str) -> str:
    return f"_{name}{next(_numbers)}"


@dataclass
class Rel:
    """A DataFrame, what of it is the element, and its order (column, ascending).

    Columns are named by the planner; those of the user's table are reached through ``elem`` only."""

    df: DataFrame
    elem: Val
    order: list[tuple[str, bool]] = field(default_factory=list)
    sorted: bool = False

    def by(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in self.order]

    def place(self) -> Column:
        """The whole order as one value that is compared upwards, nulls first where it ascends."""
        return F.struct(*(part for c, up in self.order for part in upwards(F.col(c), self.df.schema[c].dataType, up)))


def upwards(x: Column, t: T.DataType, up: bool) -> list[Column]:
    """Values whose ascending order is that of ``x`` in its direction."""
    if isinstance(t, T.NullType):
        return [F.lit(0)]
    if up:
        return [x]
    if isinstance(t, T.StructType):
        return [y for f in t.fields for y in upwards(x.getField(f.name), f.dataType, False)]
    if S.is_int(t):
        flipped = F.bitwise_not(x)
    elif kind(t) == "time":
        flipped = F.bitwise_not(F.unix_date(x).cast("long") if isinstance(t, T.DateType) else F.unix_micros(x.cast("timestamp")))
    elif kind(t) == "number":
        return [x.isNull(), ~F.isnan(x.cast("double")), -x]
    else:  # hexadecimal digits reversed; a longer string comes before its beginning
        flipped = F.concat(F.translate(F.hex(x), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return [x.isNull(), flipped]


@dataclass
class Groups:
    """Groups of a relation by a key, not collected yet; ``having`` are filters on them."""

    rel: Rel
    key: Val
    having: list[A.Node] = field(default_factory=list)


@dataclass
class Scalar:
    """One value: aggregates of relations (by name) and the value made of them."""

    parts: dict[str, tuple[Rel, Column]]
    val: Val


class _Unfit(Exception):
    """A group's body needs the collected group."""


@dataclass(frozen=True)
class _Bag:
    """``.values`` of a group while it is aggregated: elements and the condition under which they count."""

    elem: Val
    where: Column | None = None


def _bag(node: A.Node) -> bool:
    match node:
        case A.Field("values"):
            return True
        case A.Pipe(left, A.Op("map" | "filter")):
            return _bag(left)
    return False


def _aggregated(body: A.Node) -> bool:
    """Whether a group's values are aggregated wherever they stand in a body, so that their order doesn't show."""
    match body:
        case A.Pipe(left, A.Op("length" | "sum" | "avg" | "min" | "max")) if _bag(left):
            return True
        case A.Field("values") | A.Identity():
            return False
    return all(map(_aggregated, A.children(body)))


def _grouped_from(node: A.Node) -> A.Node | None:
    """What is grouped, if the node is a group_by with filters that aggregate behind it."""
    match node:
        case A.Pipe(left, A.Op("group_by")):
            return left
        case A.Pipe(left, A.Op("filter", p)) if _aggregated(p):
            return _grouped_from(left)
    return None


def _is_sorted(node: A.Node) -> bool:
    match node:
        case A.Pipe(_, A.Op("sort" | "sort_by")):
            return True
        case A.Pipe(left, A.Op("reverse" | "filter" | "map")) | A.Slice(left):
            return _is_sorted(left)
    return False


def needs_position(node: A.Node) -> bool:
    """Whether the rows' own order must be known. What stands inside of an operation works on one
    element and doesn't count; behind a sort its keys are the order."""
    match node:
        case A.Pipe(groups, A.Op("map" | "length", body)) if (left := _grouped_from(groups)) is not None:
            return needs_position(left) or (body is not None and not _aggregated(body))
        case A.Pipe(left, A.Op("group_by" | "unique_by")):
            return True
        case A.Pipe(left, A.Op("reverse" | "first" | "last" | "keys")) | A.Index(left) | A.Slice(left):
            return needs_position(left) or not _is_sorted(left)
        case A.Pipe(left, A.Op()):
            return needs_position(left)
        case A.Object() | A.Binary() | A.Text() | A.If():  # a list that is a value inside shows its order
            return any(needs_position(x) or _is_list(x) for x in A.children(node))
    return any(map(needs_position, A.children(node)))


def _is_list(node: A.Node) -> bool:
    """Whether a node gives the rows as a list."""
    match node:
        case A.Identity():
            return True
        case A.Pipe(left, A.Op(name)):
            return name in LISTS and _is_list(left)
        case A.Slice(left):
            return _is_list(left)
    return False


def _named(fields: dict[str, Val]) -> Val:
    return Val(None, T.StructType([T.StructField(k, v.type) for k, v in fields.items()]), fields)


def row_of(df: DataFrame) -> Val:
    """A row of a frame as a value: its columns are reached as such, so unused ones aren't read."""
    return _named({f.name: Val(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema.fields})


def table(df: DataFrame) -> Rel:
    """A frame as a list. Its columns get names of the planner's, so none can clash with those that it adds."""
    row = row_of(df)
    names = {k: f"c{i}" for i, k in enumerate(row.fields)}
    df = df.select(*(v.col.alias(names[k]) for k, v in row.fields.items()))
    return Rel(df, _named({k: Val(F.col(names[k]), v.type) for k, v in row.fields.items()}))


class Relations:
    """Compiles a query over a relation to a frame."""

    def __init__(self, strict: bool = True):
        self.strict, self.columns = strict, Columns(strict)

    def run(self, node: A.Node, df: DataFrame) -> DataFrame:
        rel = table(df)
        if needs_position(node):
            rel = replace(rel, df=rel.df.withColumn("_pos", F.monotonically_increasing_id()), order=[("_pos", True)])
        return self.finish(self.compile(node, rel))

    # results

    def finish(self, out) -> DataFrame:
        if isinstance(out, Groups):
            out = self.collected(out)
        if isinstance(out, Rel):
            df = out.df.orderBy(*out.by()) if out.sorted else out.df
            return df.select(*self._shown(out.elem))
        if isinstance(out, Val):
            out = Scalar({}, out)
        return self._frame(out).select(*self._shown(out.val))

    def _shown(self, v: Val) -> list[Column]:
        if v.fields:
            return [x.column().alias(k) for k, x in v.fields.items()]
        return [v.column().alias("value")]

    def _frame(self, s: Scalar) -> DataFrame:
        """One row with all parts of a scalar: an aggregation for each relation among them."""
        frames: dict[int, tuple[Rel, list[Column]]] = {}
        for name, (rel, agg) in s.parts.items():
            frames.setdefault(id(rel.df), (rel, []))[1].append(agg.alias(name))
        rows = [rel.df.agg(*aggs) for rel, aggs in frames.values()]
        if not rows:
            from pyspark.sql import SparkSession

            return SparkSession.getActiveSession().range(1)
        out = rows[0]
        for r in rows[1:]:
            out = out.crossJoin(r)  # one row by one row
        return out

    # nodes

    def compile(self, node: A.Node, ctx):
        match node:
            case A.Identity():
                return ctx
            case A.Literal(value):
                return S.literal(value)
            case A.Field(name):
                return self._value(ctx, lambda v: self.columns.field(v, name), f'cannot read field "{name}" of list')
            case A.Access(target, name):
                return self._value(self.compile(target, ctx), lambda v: self.columns.field(v, name), f'cannot read field "{name}" of list')
            case A.Pipe(left, right):
                return self.piped(self.compile(left, ctx), right)
            case A.Index(target, index):
                rel = self.compile(target, ctx)
                if isinstance(rel, (Rel, Groups)):
                    return self.index(self._rel(rel), index)
                return self._value(rel, lambda v: self.columns.index(v, index, v))
            case A.Slice(target, start, end):
                rel = self.compile(target, ctx)
                if isinstance(rel, (Rel, Groups)):
                    return self.slice(self._rel(rel), start, end)
                bounds = [None if x is None else self.columns.value(x, S.null()) for x in (start, end)]
                return self._value(rel, lambda v: self.columns.slice(v, *bounds))
            case A.Unary(op, operand):
                return self._value(self.compile(operand, ctx), lambda v: S.unary(op, v, self.strict), f"{op}: got list")
            case A.Binary(op, left, right):
                return self._join([self.compile(left, ctx), self.compile(right, ctx)], lambda a, b: S.binary(op, a, b, self.strict))
            case A.If(condition, then, otherwise):
                return self._join([self.compile(x, ctx) for x in (condition, then, otherwise)], lambda c, a, b: S.conditional(c, a, b, self.strict))
            case A.Text(parts):
                values = [S.literal(p) if isinstance(p, str) else self.compile(p, ctx) for p in parts]
                return self._join(values, lambda *v: Val(F.concat(*map(S.rendered, v)), T.StringType()))
            case A.Object(entries):

                def made(*values: Val) -> Val:
                    return _named(dict(zip([k for k, _ in entries], values, strict=True)))

                return self._join([self.compile(v, ctx) for _, v in entries], made)
        raise QueryError(f"cannot plan {node!r}")

    def _rel(self, x) -> Rel:
        return self.collected(x) if isinstance(x, Groups) else x

    def _scalar(self, x) -> Scalar:
        if isinstance(x, (Rel, Groups)):
            rel = self._rel(x)  # a list as a value inside another one
            name = _fresh("list")
            got = _gathered(rel)
            rel = replace(rel, df=rel.df.limit(LIST_ROWS + 1))  # if it is reached, the list is refused
            over = F.raise_error(F.lit(f"a list of over {LIST_ROWS} rows can't be one value")).cast(T.ArrayType(rel.elem.type))
            return Scalar({name: (rel, F.when(F.count(F.lit(1)) > LIST_ROWS, over).otherwise(got))}, Val(F.col(name), T.ArrayType(rel.elem.type)))
        return x if isinstance(x, Scalar) else Scalar({}, x)

    def _join(self, values: list, made) -> Scalar | Val:
        scalars = [self._scalar(v) for v in values]
        parts = {k: p for s in scalars for k, p in s.parts.items()}
        return Scalar(parts, made(*(s.val for s in scalars)))

    def _value(self, x, f, message: str = "expected a value, got list"):
        if isinstance(x, (Rel, Groups)):
            raise QueryError(message)
        return replace(x, val=f(x.val)) if isinstance(x, Scalar) else f(x)

    def piped(self, left, right: A.Node):
        if isinstance(left, Groups):
            done = self._grouped(left, right)
            if done is not None:
                return done
            left = self.collected(left)
        if isinstance(left, Rel):
            if isinstance(right, A.Op):
                return getattr(self, f"rel_{right.name}", self._not_list(right.name))(left, *([] if right.arg is None else [right.arg]))
            return self.compile(right, left)
        return self._value(left, lambda v: self.columns.piped(v, right))

    def _not_list(self, name: str):
        def fail(*_):
            raise QueryError(f"{name}: expected map, got list")

        return fail

    # operations on a relation

    def _with(self, rel: Rel, name: str, v: Val) -> tuple[DataFrame, str]:
        c = _fresh(name)
        return rel.df.withColumn(c, v.column()), c

    def rel_filter(self, rel: Rel, p: A.Node) -> Rel:
        out = self.columns.value(p, rel.elem)
        if kind(out.type) != "boolean":
            return replace(rel, df=rel.df.where(F.lit(False)))
        df = rel.df
        for bare in self._bare(p, rel.elem):
            df = df.where(bare)
        return replace(rel, df=df.where(out.col))

    def _bare(self, p: A.Node, elem: Val) -> list[Column]:
        """Comparisons of a field with a literal, as the scan can use them: true wherever the guarded one isn't false."""
        if not self.strict:
            return []
        match p:
            case A.Binary("&&", a, b):
                return self._bare(a, elem) + self._bare(b, elem)
            case A.Binary("<" | ">" | "<=" | ">=", A.Field() as f, A.Literal() as x):
                v, lit = self.columns.value(f, elem), S.literal(x.value)
                return [S.order(p.op, v, lit, False).col | v.col.isNull()]
            case A.Binary("==", A.Field() as f, A.Literal(str() | int() as x)) if not isinstance(x, bool):
                v = self.columns.value(f, elem)
                return [v.col == F.lit(x)] if kind(v.type) == kind(S.literal(x).type) else []
        return []

    def rel_map(self, rel: Rel, e: A.Node) -> Rel:
        v = self.columns.value(e, rel.elem)
        return replace(rel, elem=v)

    def _sorted(self, rel: Rel, op: str, v: Val) -> Rel:
        if kind(v.type) not in ("number", "string", "time", "null"):
            raise QueryError(f"{op}: cannot compare {kind(v.type)}")
        key = Val(S.checked(v, op, self.strict), v.type) if v.fields is None else v
        df, c = self._with(rel, "key", key)
        return replace(rel, df=df, order=[(c, True), *rel.order], sorted=True)

    def rel_sort(self, rel: Rel) -> Rel:
        return self._sorted(rel, "sort", rel.elem)

    def rel_sort_by(self, rel: Rel, k: A.Node) -> Rel:
        return self._sorted(rel, "sort_by", self.columns.value(k, rel.elem))

    def rel_reverse(self, rel: Rel) -> Rel:
        return replace(rel, order=[(c, not up) for c, up in rel.order], sorted=True)

    def _limited(self, rel: Rel, offset: int, n: int | None) -> Rel:
        if offset + (n or 0) > TOP_ROWS or (n is None and offset):
            return self._numbered(rel, offset, n)
        df = rel.df.orderBy(*rel.by())
        df = df.offset(offset) if offset else df
        return replace(rel, df=df.limit(n) if n is not None else df, sorted=True)

    def _numbered(self, rel: Rel, offset: int, n: int | None) -> Rel:
        """Rows ``offset`` to ``offset + n`` of the order, by ranges of it: each task sorts one range, the ranges
        are counted, and a row's number is its range's start and its place there. No task has all rows. The
        sorted rows are written to the checkpoint folder, since another run might cut other ranges."""
        checkpoints(rel.df.sparkSession)
        at, start = _fresh("at"), _fresh("start")
        df = rel.df.orderBy(*rel.by()).withColumn(at, F.monotonically_increasing_id()).checkpoint()
        part = F.shiftright(at, 33)
        counts = {r["p"]: r["n"] for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
        starts = list(accumulate((counts.get(p, 0) for p in range(max(counts, default=-1) + 1)), initial=0))
        if counts:
            df = df.withColumn(start, F.get(F.array(*map(F.lit, starts)).cast("array<bigint>"), part.cast("int")) + F.col(at).bitwiseAND((1 << 33) - 1))
            df = df.where(F.col(start) >= offset) if n is None else df.where((F.col(start) >= offset) & (F.col(start) < offset + n))
            df = df.drop(at).withColumnRenamed(start, at)
        return replace(rel, df=df, order=[(at, True)], sorted=True)

    def _only(self, rel: Rel) -> Scalar:
        name = _fresh("one")
        return Scalar({name: (rel, F.first(F.struct(rel.elem.column().alias("e"))))}, Val(F.col(name)["e"], rel.elem.type))

    def index(self, rel: Rel, index: A.Node) -> Scalar:
        i = self._constant(index, "index")
        if i < 0:
            rel, i = self.rel_reverse(rel), -i - 1
        return self._only(self._limited(rel, i, 1))

    def slice(self, rel: Rel, start: A.Node | None, end: A.Node | None) -> Rel:
        s = None if start is None else self._constant(start, "slice")
        e = None if end is None else self._constant(end, "slice")
        if (s or 0) >= 0 and (e is None or e >= 0):
            return self._limited(rel, s or 0, None if e is None else max(0, e - (s or 0)))
        if (s is None or s < 0) and (e is None or e < 0):  # counted from the end
            back = self._limited(self.rel_reverse(rel), -e if e else 0, None if s is None else max(0, -s + (e or 0)))
            return self.rel_reverse(back)
        n = rel.df.count()
        low = max(0, s + n) if s is not None and s < 0 else min(n, s or 0)
        high = n if e is None else max(0, e + n) if e < 0 else min(n, e)
        return self._limited(rel, low, max(0, high - low))

    def _constant(self, node: A.Node, op: str) -> int:
        match node:
            case A.Literal(int() | float() as x) if not isinstance(x, bool):
                return int(x)
            case A.Unary("-", A.Literal(int() | float() as x)):
                return -int(x)
        raise QueryError(f"{op}: a list of rows takes constant numbers")

    def rel_first(self, rel: Rel) -> Scalar:
        return self._only(self._limited(rel, 0, 1))

    def rel_last(self, rel: Rel) -> Scalar:
        return self._only(self._limited(self.rel_reverse(rel), 0, 1))

    def rel_group_by(self, rel: Rel, k: A.Node) -> Groups:
        return Groups(rel, self.columns.value(k, rel.elem))

    def rel_unique(self, rel: Rel) -> Rel:
        df, c = self._with(rel, "elem", rel.elem)
        if not rel.order:
            return Rel(df.groupBy(c).agg(F.count(F.lit(1)).alias(_fresh("n"))), Val(F.col(c), rel.elem.type))
        return self._one_each(replace(rel, df=df), c, Val(F.col(c), rel.elem.type))

    def rel_unique_by(self, rel: Rel, k: A.Node) -> Rel:
        df, c = self._with(rel, "key", Val(self.columns._key(self.columns.value(k, rel.elem)), T.NullType()))
        return self._one_each(replace(rel, df=df), c, rel.elem)

    def _one_each(self, rel: Rel, key: str, elem: Val) -> Rel:
        """The first element of each key: a combinable aggregate, not a window."""
        place, e = _fresh("place"), _fresh("elem")
        df = rel.df.groupBy(key).agg(F.min_by(elem.column(), rel.place()).alias(e), F.min(rel.place()).alias(place))
        return Rel(df, Val(F.col(e), elem.type), [(place, True)], rel.sorted)

    def rel_flatten(self, rel: Rel) -> Rel:
        t = rel.elem.type
        if not isinstance(t, T.ArrayType):
            return rel
        at, e = _fresh("at"), _fresh("item")
        items = F.coalesce(rel.elem.column(), F.array(F.lit(None).cast(t.elementType)))
        df = rel.df.select("*", F.posexplode(items).alias(at, e))
        return replace(rel, df=df, elem=Val(F.col(e), t.elementType), order=[*rel.order, (at, rel.order[-1][1] if rel.order else True)] if rel.order else [])

    def _agg(self, rel: Rel, agg: Column, t: T.DataType) -> Scalar:
        name = _fresh("agg")
        return Scalar({name: (rel, agg)}, Val(F.col(name), t))

    def aggregate(self, op: str, v: Val, where: Column | None = None) -> Val:
        """sum, avg, min, max or length as an aggregate expression."""
        if op == "length":
            return Val(F.count(F.lit(1)) if where is None else F.count(F.when(where, 1)), T.LongType())
        if op in ("sum", "avg") and kind(v.type) not in ("number", "null"):
            raise S.type_error(op, "number", v)
        if op in ("min", "max") and kind(v.type) not in ("number", "string", "time"):
            raise QueryError(f"{op}: cannot compare {kind(v.type)}")
        x = S.checked(v, op, self.strict)
        x = x if where is None else F.when(where, x)
        if op == "sum":
            t = T.LongType() if S.is_int(v.type) or kind(v.type) == "null" else T.DoubleType()
            return Val(F.coalesce(F.sum(x.cast(t)), F.lit(0).cast(t)), t)
        t = T.DoubleType() if op == "avg" else v.type
        out = {"avg": F.avg, "min": F.min, "max": F.max}[op](x)
        return Val(F.when(F.count(x) == 0, F.raise_error(F.lit(f"{op}: empty list")).cast(t)).otherwise(out), t)

    def _whole(self, op: str, rel: Rel) -> Scalar:
        v = self.aggregate(op, rel.elem)
        return self._agg(rel, v.col, v.type)

    def rel_length(self, rel: Rel) -> Scalar:
        return self._whole("length", rel)

    def rel_sum(self, rel: Rel) -> Scalar:
        return self._whole("sum", rel)

    def rel_avg(self, rel: Rel) -> Scalar:
        return self._whole("avg", rel)

    def rel_min(self, rel: Rel) -> Scalar:
        return self._whole("min", rel)

    def rel_max(self, rel: Rel) -> Scalar:
        return self._whole("max", rel)

    def rel_values(self, rel: Rel) -> Rel:
        return rel

    def rel_keys(self, rel: Rel) -> Rel:
        """0 to n - 1: the rows are counted, then made where they are needed."""
        return Rel(rel.df.sparkSession.range(rel.df.count()), Val(F.col("id"), T.LongType()), [("id", True)], True)

    def rel_has(self, rel: Rel, k: A.Node) -> Scalar:
        i = self._constant(k, "has")
        name = _fresh("agg")
        return Scalar({name: (rel, F.count(F.lit(1)))}, Val((F.lit(i) >= 0) & (F.col(name) > i), T.BooleanType()))

    def rel_from_entries(self, rel: Rel) -> Scalar:
        s = self._scalar(rel)
        return replace(s, val=self.columns.op_from_entries(s.val))

    # groups

    def _grouped(self, g: Groups, right: A.Node):
        """An operation on groups without collecting them, or None if that can't be."""
        if not isinstance(right, A.Op):
            return None
        if right.name == "filter":
            try:
                self._body(g, right.arg)
            except _Unfit:
                return None
            return replace(g, having=[*g.having, right.arg])
        if right.name == "length" and not g.having:
            df, c = self._with(g.rel, "key", Val(self.columns._key(g.key), g.key.type))
            return self.rel_length(Rel(df.select(c).distinct(), Val(F.col(c), g.key.type)))
        if right.name != "map":
            return None
        try:
            body = self._body(g, right.arg)
            tests = [self._body(g, p) for p in g.having]
        except _Unfit:
            return None
        names = {k: _fresh("out") for k in body.fields} if body.fields is not None else {"value": _fresh("out")}
        values = body.fields if body.fields is not None else {"value": body}
        aggs = [v.column().alias(names[k]) for k, v in values.items()]
        aggs += [F.coalesce(t.col, F.lit(False)).alias(f"_h{i}") if kind(t.type) == "boolean" else F.lit(False).alias(f"_h{i}") for i, t in enumerate(tests)]
        aggs, order = self._ordered(g.rel, aggs)
        df = g.rel.df.withColumn("_gkey", self.columns._key(g.key)).groupBy("_gkey").agg(*aggs)
        for i in range(len(tests)):
            df = df.where(f"_h{i}")
        out = {k: Val(F.col(n), values[k].type) for k, n in names.items()}
        elem = Val(None, body.type, out) if body.fields is not None else out["value"]
        return Rel(df, elem, order, bool(order))

    def _ordered(self, rel: Rel, aggs: list[Column]) -> tuple[list[Column], list[tuple[str, bool]]]:
        """Groups come in the order of their first element."""
        if not rel.order:
            return aggs, []
        place = _fresh("place")
        return [*aggs, F.min(rel.place()).alias(place)], [(place, True)]

    def _body(self, g: Groups, node: A.Node) -> Val:
        """The body of a map over groups, as one expression over aggregates."""
        key = Val(F.col("_gkey"), g.key.type)
        bag = _Bag(g.rel.elem)

        def value(n: A.Node) -> Val:
            out = walk(n)
            if isinstance(out, _Bag):
                raise _Unfit
            return out

        def walk(n: A.Node):
            match n:
                case A.Field("key"):
                    if isinstance(g.key.type, T.MapType):
                        raise _Unfit
                    return key
                case A.Field("values"):
                    return bag
                case A.Field():
                    return S.null()
                case A.Literal(x):
                    return S.literal(x)
                case A.Access(target, name):
                    return self.columns.field(value(target), name)
                case A.Pipe(left, A.Op(name, arg)):
                    return step(walk(left), name, arg)
                case A.Unary(op, x):
                    return S.unary(op, value(x), self.strict)
                case A.Binary(op, a, b):
                    return S.binary(op, value(a), value(b), self.strict)
                case A.If(c, a, b):
                    return S.conditional(value(c), value(a), value(b), self.strict)
                case A.Text(parts):
                    return Val(F.concat(*(F.lit(p) if isinstance(p, str) else S.rendered(value(p)) for p in parts)), T.StringType())
                case A.Object(entries):
                    return _named({k: value(v) for k, v in entries})
            raise _Unfit

        def step(left, name: str, arg: A.Node | None):
            if not isinstance(left, _Bag):
                return self.columns.piped(left, A.Op(name, arg))
            if name == "map":
                return replace(left, elem=self.columns.value(arg, left.elem))
            if name == "filter":
                p = self.columns.value(arg, left.elem)
                test = F.coalesce(p.col, F.lit(False)) if kind(p.type) == "boolean" else F.lit(False)
                return replace(left, where=test if left.where is None else F.when(left.where, test).otherwise(False))
            if name in ("length", "sum", "avg", "min", "max"):
                return self.aggregate(name, left.elem, left.where)
            raise _Unfit

        return value(node)

    def collected(self, g: Groups) -> Rel:
        """Groups with their values, in order: for bodies that need each element. The largest group is counted first."""
        rel, key = g.rel, _fresh("gkey")
        df = rel.df.withColumn(key, self.columns._key(g.key))
        largest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest > LIST_ROWS:
            raise QueryError(f"group_by: a group of {largest} rows can't be one value (at most {LIST_ROWS}); aggregate its values")
        first, values = _fresh("first"), _fresh("values")
        aggs, order = self._ordered(rel, [F.first(F.struct(g.key.column().alias("k")))["k"].alias(first), _gathered(rel).alias(values)])
        out = Rel(df.groupBy(key).agg(*aggs), _named({"key": Val(F.col(first), g.key.type), "values": Val(F.col(values), T.ArrayType(rel.elem.type))}), order, bool(order))
        for p in g.having:
            out = self.rel_filter(out, p)
        return out


def _gathered(rel: Rel) -> Column:
    """The elements as one array, in order."""
    if not rel.order:
        return F.collect_list(F.struct(rel.elem.column().alias("e")))["e"]
    rows = F.collect_list(F.struct(rel.place().alias("p"), rel.elem.column().alias("e")))
    return F.array_sort(rows, lambda a, b: F.when(a["p"] < b["p"], -1).when(b["p"] < a["p"], 1).otherwise(0))["e"]


def checkpoints(spark) -> None:
    """The folder that the session names for checkpoints; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found and not sc.master.startswith("local"):
        raise QueryError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="docsieve-"))
