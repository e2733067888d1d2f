"""Both planes against the value semantics, plans, errors, and other ways in."""

import json

import pytest

from docsieve import QueryError, assert_query, compile, infer_schema, query
from docsieve.functions.values import run
from docsieve.plans.grammar import parse
from docsieve.streaming import query_stream

PEOPLE = [
    {"name": "Carol", "age": 45, "dept": "eng", "tags": ["a", "b"], "score": 1.5},
    {"name": "Alice", "age": 25, "dept": "eng", "tags": [], "score": 2.0},
    {"name": "Bob", "age": 35, "dept": "sales", "tags": ["b"], "score": -1.0},
    {"name": "Dave", "age": 30, "dept": "sales", "tags": ["c", "a", "c"], "score": 0.5},
    {"name": "Eve", "age": 35, "dept": None, "tags": ["b"], "score": 4.25},
]
SCHEMA = "name string, age bigint, dept string, tags array<string>, score double"
LISTS = [
    ". | filter(.age > 30)", ". | filter(.dept)", ". | map(.name)", ". | map(.dept)", ". | map({name, old: .age >= 35})", ". | sort_by(.name) | map(.name)",
    ". | map(.age) | sort", ". | reverse | map(.name)", "(. | sort_by(.age))[1:3] | map(.name)", ".[-2:] | map(.name)", ".[:2] | map(.name)", ".[1:-1] | map(.name)", ".[-3:4] | map(.name)", ".[7:9]",
    ". | group_by(.dept) | map({k: .key, n: .values | length})", ". | group_by(.dept) | map({k: .key, names: .values | map(.name)})", ". | group_by(.age > 30) | map({k: .key, s: .values | map(.score) | sum, m: .values | map(.age) | max})",
    ". | group_by(.dept) | filter(.values | length > 1) | map(.key)", ". | map(.dept) | unique", ". | unique_by(.age) | map(.name)", ". | map(.tags) | flatten", ". | map(.tags) | flatten | unique", ". | map(.tags | length)",
    ". | map(.tags | unique | sort)", ". | map(.tags[0])", ". | map(.tags[-1])", ". | map(.tags[:1])", ". | map(.tags | filter(. == \"b\") | length)", ". | map(.tags | first)", ". | map(.tags | last)", ". | map(.tags | reverse)",
    ". | map(.tags | group_by(.) | map({k: .key, n: .values | length}))", ". | map(.tags | keys)", ". | map(.tags | has(1))", ". | map(.name[1:3])", ". | map(.name | length)", '. | map("\\(.name)/\\(.dept)/\\(.score)/\\(.tags)")',
    ". | map(.age % 7)", ". | map(.age / 0)", ". | map(-.age + 2 * 3)", ". | map(if .age > 30 then .name else .dept)", ". | map(. | has(\"name\"))", ". | map(. | keys | length)", ". | map({a: 1, b: 2} | to_entries | map(.value) | sum)",
    ". | map({a: 1, b: 5} | map_values(. + 1) | filter_values(. > 2) | keys)", ". | map({a: 1, b: 5} | filter_keys(. == \"b\") | values)", ". | map(.tags == .tags)", ". | map(.dept == null)", ". | map(.nothing | length)", ". | map(.tags | sort_by(.) | first)",
]
VALUES = [". | length", ". | map(.age) | sum", ". | map(.score) | sum", ". | map(.age) | avg", ". | map(.name) | min", ". | map(.score) | max", ". | length > 3", ".[1].name", ".[-1].name", ".[99]", ". | first | .name", "(. | sort_by(.age) | last).name", ". | map(.dept) | unique | length", ". | has(4)", ". | has(5)", ". | map(.tags) | flatten | length", "(. | map(.age) | sum) / (. | length)", 'if . | length > 2 then "many" else "few"', '"\\(. | length) rows"']


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([tuple(p.values()) for p in PEOPLE], SCHEMA).coalesce(1)


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x


@pytest.mark.parametrize("text", LISTS)
def test_list(people, text):
    want = run(parse(text).node, PEOPLE)
    out = query(text, people)
    got = [plain(r[0] if out.columns == ["value"] else r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) if "sort" not in text and "[" not in text else got == want


@pytest.mark.parametrize("text", VALUES)
def test_value(people, text):
    rows = query(text, people).collect()
    assert len(rows) == 1 and plain(rows[0][0]) == run(parse(text).node, PEOPLE)


@pytest.mark.parametrize("text", [t for t in LISTS if ".[-3:4]" not in t])
def test_nested(spark, people, text):
    """The same list inside of one row."""
    from pyspark.sql import functions as F

    doc = people.select(F.struct("*").alias("p")).agg(F.collect_list("p").alias("people"))
    inner = text.replace(". |", ".people |", 1) if text.startswith((". |", "(. |")) else ".people" + text[1:]
    inner = inner.replace("(. |", "(.people |", 1) if text.startswith("(. |") else inner
    assert plain(compile(inner).each(doc).first()["value"]) == run(parse(inner).node, {"people": PEOPLE})


def test_errors(people, spark):
    for text in (". | sort", ". | map(.name) | sum", ".name", ". | map(.name + 1)", ". | map(.age | length)", ". | keys | keys | to_entries", ". | map(.tags < 1)"):
        with pytest.raises(QueryError):
            query(text, people)
    for text in (". | map(.missing_ok) | avg", ". | filter(.age > 100) | map(.age) | avg", ". | filter(.age > 100) | map(.age) | min"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            query(text, people).collect()
    null = spark.createDataFrame([(1, None)], "a bigint, b bigint")
    with pytest.raises(Exception, match="got null"):
        query(". | map(.a + .b)", null).collect()
    assert query(". | map(.a + .b)", null, strict=False).collect()[0][0] is None


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    p = plan(query(". | filter(.l_quantity > 45) | map({l_orderkey})", li))
    assert "PushedFilters: [Or(GreaterThan(l_quantity,45.0),IsNull(l_quantity))]" in p and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    p = plan(query(". | group_by(.l_returnflag) | map({k: .key, n: .values | length})", li))
    assert "collect_list" not in p and "partial_count" in p and "monotonically" not in p
    p = plan(query("{n: . | length, s: . | map(.l_quantity) | sum}", li))
    assert p.split("== Physical Plan ==")[1].count("FileScan") == 1
    p = plan(query("(. | sort_by(.l_extendedprice) | reverse)[:5]", li))
    assert "TakeOrderedAndProject" in p and "monotonically" not in p


def test_documents(spark):
    texts = spark.createDataFrame([(1, '{"a": {"b": [1, "x", null]}}'), (2, "a:\n  b: [2]"), (3, None), (4, "{bad")], "id bigint, text string")
    out = compile(".a.b | first").documents(texts, "text", errors="keep").collect()
    assert [r["value"] for r in out] == ["1", "2", None, None] and out[3]["error"] and out[2]["error"] is None
    with pytest.raises(Exception):  # noqa: B017, PT011
        compile(".").documents(texts, "text", "json").collect()


def test_sources(spark, tmp_path):
    from docsieve.sources import spark as S

    df = spark.createDataFrame([(1, "a"), (2, None)], "x bigint, y string")
    for fmt in ("parquet", "orc", "jsonl", "csv", "tsv", "xml"):
        S.write(df, f"{tmp_path}/{fmt}", fmt)
        back = S.read(spark, f"{tmp_path}/{fmt}", fmt)
        assert sorted(str(r["x"]) for r in back.collect()) == ["1", "2"]
    (tmp_path / "c.toml").write_text("[a]\nb = 3\n")
    assert json.loads(compile(".a.b").documents(S.documents(spark, f"{tmp_path}/c.toml"), "text", "toml").first()["value"]) == 3
    assert S.read(spark, f"{tmp_path}/c.toml", schema="a struct<b:bigint>").first()["a"]["b"] == 3
    (tmp_path / "d.csv").write_text("x;y\n1;a,b\n2;c\n")
    assert [tuple(r) for r in S.read(spark, f"{tmp_path}/d.csv").collect()] == [("1", "a,b"), ("2", "c")]
    (tmp_path / "e.yaml").write_text("- {x: no, y: 012}\n- {x: z, y: 7}\n")
    assert [tuple(r) for r in S.read(spark, f"{tmp_path}/e.yaml", schema="x string, y bigint").collect()] == [("no", 12), ("z", 7)]
    (tmp_path / "f.md").write_text("# T\n\n- a\n")
    assert compile(".value.type").each(S.read(spark, f"{tmp_path}/f.md"), name="t").selectExpr("cast(t as string)").first()[0] == "document"


def test_assert_and_schema(people):
    assert assert_query(". | length == 5", people) and not assert_query(". | length > 5", people)
    with pytest.raises(QueryError):
        assert_query(". | length", people)
    assert infer_schema(people) == [{"name": "string", "age": "number", "dept": "string", "tags": ["string"], "score": "number"}]


def test_stream(spark, people, tmp_path):
    people.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = query_stream(". | filter(.age > 30) | map({name})", stream).writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.table("seen").collect()) == ["Bob", "Carol", "Eve"]
    with pytest.raises(QueryError):
        query_stream(". | length", stream)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["l_orderkey", "l_linenumber", "l_quantity"]
    assert set(e.oracle_sql()) <= set(e.queries())


ORDERED = [
    ". | sort_by(-.age) | unique_by(.dept) | map(.name)", ". | sort_by(.name) | reverse | unique_by(.age) | map(.name)", ". | sort_by(-.age) | group_by(.dept) | map({k: .key, names: .values | map(.name)})",
    ". | sort_by(.name) | reverse | group_by(.dept) | map({k: .key, n: .values | length})", ". | sort_by(.name) | reverse | sort_by(.age) | map(.name)", ". | sort_by(.score) | reverse | group_by(.age > 30) | reverse | map(.key)",
    ". | sort_by(.name) | reverse | group_by(.age) | sort_by(.values | length) | map(.key)", ". | sort_by(.name) | reverse | group_by(.dept) | reverse | unique_by(.values | length) | map(.key)",
]


@pytest.mark.parametrize("text", ORDERED)
def test_order_is_kept(people, text):
    got = [plain(r[0] if len(r) == 1 else r) for r in query(text, people).collect()]
    assert got == run(parse(text).node, PEOPLE)


def test_list_inside_object(people, monkeypatch):
    from docsieve.operators import relation

    for text in ("{a: . | sort_by(.age) | reverse | map(.name), n: . | length}", "{a: . | map(.name), b: . | sort_by(.name) | reverse | map(.age)}", "{g: . | sort_by(-.score) | group_by(.dept) | map({k: .key, v: .values | map(.name)})}"):
        assert plain(query(text, people).first()) == run(parse(text).node, PEOPLE)
    monkeypatch.setattr(relation, "LIST_ROWS", 3)
    with pytest.raises(Exception, match="over 3 rows"):
        query("{a: . | map(.name)}", people).collect()
    with pytest.raises(QueryError, match="group of 5 rows"):
        query(". | group_by(.age > 0) | map(.values | map(.name))", people).collect()


def test_far_slices(spark, monkeypatch):
    from docsieve.operators import relation

    df = spark.range(0, 3000, 1, 7).selectExpr("(id * 7919) % 3000 as x", "id")
    rows = [r.asDict() for r in df.collect()]
    monkeypatch.setattr(relation, "TOP_ROWS", 10)
    for text in ("(. | sort_by(.x))[2000:] | map(.x)", "(. | sort_by(.x))[700:703] | map(.x)", ".[2990:] | map(.id)", "(. | sort_by(.x) | reverse)[-5:] | map(.x)", "(. | sort_by(.x))[4000:] | map(.x)", "(. | filter(.x < 0))[1:] | map(.x)"):
        out = query(text, df)
        assert [r[0] for r in out.collect()] == run(parse(text).node, rows)
    assert "SinglePartition" not in plan(query("(. | sort_by(.x))[2000:] | map(.x)", df))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(2, "a", 1, {"k": 1}), (1, "a", 5, {"k": 1}), (3, "b", 4, None)], "_pos bigint, _gkey string, _position bigint, `_e` map<string,bigint>")
    assert query(".", df).columns == df.columns
    assert [r[0] for r in query(". | reverse | map(._pos)", df.coalesce(1)).collect()] == [3, 1, 2]
    assert sorted(tuple(r) for r in query(". | group_by(._gkey) | map({k: .key, n: .values | map(._position) | sum})", df).collect()) == [("a", 6), ("b", 4)]
    assert query(". | group_by(._e) | length", df).first()[0] == 2
    out = compile(".a").documents(spark.createDataFrame([('{"a": 1}', "old", 5)], "text string, value string, error bigint"), "text")
    assert out.columns == ["text", "value", "error"] and out.first()["value"] == "1"


def test_lists_in_n_log_n(spark):
    data = {"x": [{"k": k % 5000, "v": k} for k in range(30_000)], "e": [{"key": f"n{k % 7000}", "value": k} for k in range(20_000)]}
    df = spark.createDataFrame([(data["x"], data["e"])], "x array<struct<k:bigint,v:bigint>>, e array<struct<key:string,value:bigint>>")
    for text in (".x | group_by(.k) | map({k: .key, n: .values | map(.v) | sum})", ".x | unique_by(.k) | map(.v)", ".e | from_entries", ".x | map({k: .k}) | unique"):
        assert plain(compile(text).each(df, name="out").first()["out"]) == run(parse(text).node, data)
