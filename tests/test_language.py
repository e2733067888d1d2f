"""Values, grammar and errors: (query, input, result or error). What a rule of the language fixes is a result here; the data are our own."""

import math

import pytest

from docsieve import EvalError, QueryError, query, query_text
from docsieve.functions.values import number_text, schema_of
from docsieve.plans import ast as A
from docsieve.plans.grammar import parse

DOC = {
    "boats": [{"berth": "North", "length": 7, "rigged": True}, {"berth": "South", "length": 12, "rigged": False}, {"berth": "Quay", "length": 17, "rigged": True}],
    "harbour": {"office": {"street": "Pier 4", "phone": 2231}, "open": False},
    "edition": "b7",
    "flags": ["red", "blue", "striped"],
}
ROWS = [
    (".boats | filter(.length > 9 && .rigged)", DOC, [DOC["boats"][2]]),
    (".boats | filter(.rigged) | sort_by(-.length) | map(.berth)", DOC, ["Quay", "North"]),
    (".flags | length > 2", DOC, True),
    (".boats | map(.length) | avg", DOC, 12.0),
    (".boats[-2].berth", DOC, "South"),
    (".boats[14]", DOC, None),
    (".harbour.office.phone % 100", DOC, 31),
    ("-7 % 3", {}, 2),
    (".missing | length", DOC, None),
    (". | filter(.x)", [{"x": True}, {"x": 1}, {"x": None}, {}], [{"x": True}]),
    (". | group_by(.t) | map({t: .key, n: .values | map(.a) | sum})", [{"t": "x", "a": 3}, {"t": "y", "a": 11}, {"t": "x", "a": 4}, {"t": "y", "a": 6}], [{"t": "x", "n": 7}, {"t": "y", "n": 17}]),
    (". | to_entries | filter(.value > 3) | from_entries", {"p": 2, "q": 9, "r": 3, "s": 4}, {"q": 9, "s": 4}),
    ('. | filter_keys(. != "draft")', {"title": "T", "draft": 1, "pages": 9}, {"title": "T", "pages": 9}),
    (". | filter_values(.)", {"wet": False, "cold": True}, {"cold": True}),
    (". | map_values(. * 2)", {"a": 1}, {"a": 2}),
    (". | flatten", [1, [2, [3]]], [1, 2, [3]]),
    (". | unique", [3, 1, 3, 2, 1], [3, 1, 2]),
    (". | unique_by(.id) | map(.n)", [{"id": 1, "n": "a"}, {"id": 1, "n": "b"}], ["a"]),
    (".[-2:]", [10, 20, 30], [20, 30]),
    (".[:-1]", [10, 20, 30], [10, 20]),
    (".[5:10]", [1], []),
    ("(. | sort)[:3]", [5, 3, 1, 4, 2], [1, 2, 3]),
    (". | sort[:2]", [5, 3, 1], [1, 3]),
    (". | sum", [], 0),
    (". | sum", [1, 2.5], 3.5),
    (". | min", ["b", "a"], "a"),
    (". | max", [1, 7, 3], 7),
    (". | reverse", [1, 2], [2, 1]),
    (". | keys", {"z": 1, "a": 2}, ["z", "a"]),
    (". | keys", ["x", "y"], [0, 1]),
    (". | values", {"z": 1, "a": 2}, [1, 2]),
    (". | length", "a😀b", 4),
    (".[1:3]", "a😀b", "😀"),
    (". | has(\"x\")", {"x": None}, True),
    (". | has(-1)", [1], False),
    (". | first", [], None),
    (". | last", [1, 2], 2),
    ("(.a / .b)", {"a": 1, "b": 0}, math.inf),
    ("6 / 3", {}, 2.0),
    ('.a + "x"', {"a": "y"}, "yx"),
    ('"\\(.name) is \\(.age), \\(.none), \\(.l), \\(.m)"', {"name": "A", "age": 2.0, "l": [1, "x"], "m": {"k": True}}, "A is 2.0, null, [1, x], {k: true}"),
    ("{name, n: 1, n: 2}", {"name": "A"}, {"name": "A", "n": 2}),
    ("if .a then 1 else 2", {"a": False}, 2),
    ("null == .a", {}, True),
    ("1 == 1.0", {}, True),
    (". == .", {"a": [1, {"b": 2}]}, True),
    ('.["a-b"]', {"a-b": 1}, 1),
    (".a | .b[.i]", {"a": {"b": [7, 8]}, "i": 1}, 8),
    (".null | (. + 1)", {}, None),
    (".filter", {"filter": 3}, 3),
    ("1 + 2 * 3 == 7 && !false", {}, True),
]
ERRORS = [
    (".missing + 5", DOC, EvalError), (".missing > 5", DOC, EvalError), ("if .missing then 1 else 2", DOC, EvalError), ("-.missing", DOC, EvalError),
    ("false && .missing", DOC, EvalError), (". | avg", [], QueryError), (". | min", [], QueryError), (". | sort", [1, "a"], EvalError), (".a", [1], QueryError),
    (". | sum", [1, None], QueryError), (". | length", 5, QueryError), (". | from_entries", [{"value": 1}], QueryError), (". | keys", 1, QueryError), ('1 + "a"', {}, EvalError),
    ("true < 1", {}, EvalError), (". | reverse", {}, QueryError), (".[0]", 1, QueryError), (". | has(1)", {}, QueryError),
]


@pytest.mark.parametrize("text,data,expected", ROWS)
def test_value(text, data, expected):
    assert query(text, data) == expected


@pytest.mark.parametrize("text,data,error", ERRORS)
def test_error(text, data, error):
    with pytest.raises(error):
        query(text, data)


def test_nan():
    assert math.isnan(query(".a % .b", {"a": 1, "b": 0}))


@pytest.mark.parametrize("text", [".[]", "..", "(.a", ".a ||", '"abc', "{a b}", ". | map(.x", "filter(.x)", "if .a then 1", "{1: 2}", ". | ", '"\\q"', "1 2"])
def test_parse_error(text):
    with pytest.raises(QueryError, match="parse error at column"):
        parse(text)


def test_suggestion():
    with pytest.raises(QueryError, match='did you mean "filter"'):
        parse(".x | filtr(.a)")


@pytest.mark.parametrize("text", ["(.a", ".a[0", '"abc', "{a", ". | map(.x", ".x | filter(", ".a[1:", '"n: \\(.na', ". | map({t: .p"])
def test_lenient(text):
    assert not parse(text, lenient=True).complete


def test_shapes():
    assert parse(".flags | length > 2").node == A.Binary(">", A.Pipe(A.Field("flags"), A.Op("length")), A.Literal(2))
    assert parse("-5 | .x").node == A.Unary("-", A.Pipe(A.Literal(5), A.Field("x")))
    assert parse("1 - 2 - 3").node == A.Binary("-", A.Binary("-", A.Literal(1), A.Literal(2)), A.Literal(3))


@pytest.mark.parametrize("x,text", [(1.0, "1.0"), (1e7, "10000000.0"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (0.1, "0.1"), (1e-5, "0.00001"), (math.inf, "Infinity"), (2.5, "2.5")])
def test_number_text(x, text):
    assert number_text(x) == text


def test_schema():
    assert schema_of({"a": [1, "x"], "b": None, "c": [], "d": {"e": True}}) == {"a": ["number"], "b": "null", "c": [], "d": {"e": "boolean"}}


def test_json_text():
    assert query_text(".boats | map(.berth)", '{"boats":[{"berth":"North"},{"berth":"Quay"}]}') == ["North", "Quay"]
