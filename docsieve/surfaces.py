"""Registered queries of sources, sinks and the other ways in, each with the same in SQL.

Sources: a driver's table is written in a format and read again. Sinks: each row
becomes a document's text in a format, and that is parsed again. The rest calls
the function or command on a small table or text."""

from __future__ import annotations

import atexit
import contextlib
import io
import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, cli, testing
from .complete import complete
from .errors import QueryError
from .operators.documents import render
from .operators.relation import checkpoints
from .plans.grammar import parse
from .sources import spark as S

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _registered(name: str, sql: str):
    def keep(f):
        _queries[name], _sql[name] = f, sql
        return f

    return keep


def _folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; it goes with the session."""
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}/{name}"

    def gone() -> None:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(gone)
    return path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# sources: a table in each format

RICH = ". | filter(.c_acctbal > 1000) | map({c_custkey, c_name, c_acctbal})"
RICH_SQL = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000"


def _source(fmt: str, ending: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, f"customer{ending}")
        S.write(_table(spark, sf_dir, "customer"), path, fmt)
        return api.query(RICH, S.read(spark, path, None if fmt in ("csv", "tsv", "xml") else fmt, CUSTOMER))  # by its ending

    return run


for _fmt, _ending in (("csv", ".csv"), ("tsv", ".tsv"), ("jsonl", ".jsonl"), ("xml", ".xml"), ("orc", ".orc"), ("parquet", "")):
    _registered(f"source_{_fmt}", RICH_SQL)(_source(_fmt, _ending))


@_registered("source_csv_dialect", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation")
def _semicolons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "nation.csv")
    _table(spark, sf_dir, "nation").write.csv(path, header=True, sep=";")
    return api.query(". | map({k: .n_nationkey, name: .n_name})", S.read(spark, path))


@_registered("source_json_list", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "nation.json")
    rows = _table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("text"))
    rows.coalesce(1).write.text(path)
    return S.read(spark, path, schema="n_nationkey bigint, n_name string")


#: A line for each nation, which together are one document.
LINES = {
    "yaml": "concat('- {k: ', n_nationkey, ', name: ', n_name, '}')",
    "toml": "concat('[[row]]\nk = ', n_nationkey, '\nname = \"', n_name, '\"')",
    "hcl": "concat('row \"r\" {\n  k = ', n_nationkey, '\n  name = \"', n_name, '\"\n}')",
}


def _whole(fmt: str, ending: str, schema: str, query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark, f"nation{ending}")
        _table(spark, sf_dir, "nation").orderBy("n_nationkey").selectExpr(LINES[fmt]).coalesce(1).write.text(path)
        return api.query(query, S.read(spark, path, fmt, schema))

    return run


NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation"
_registered("source_yaml", NATIONS)(_whole("yaml", ".yaml", "k bigint, name string", "."))
_registered("source_toml", NATIONS)(_whole("toml", ".toml", "row array<struct<k:bigint,name:string>>", ". | map(.row) | flatten | map({k, name})"))
_registered("source_hcl", NATIONS)(_whole("hcl", ".tf", "row array<struct<_labels:array<string>,k:bigint,name:string>>", ". | map(.row) | flatten | map({k, name})"))


@_registered("source_hcl_labels", "SELECT CAST(n_nationkey AS BIGINT) AS k, 'r' AS label FROM nation")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole("hcl", ".hcl", "row array<struct<_labels:array<string>,k:bigint>>", ". | map(.row) | flatten | map({k, label: ._labels | first})")(spark, sf_dir)


# documents that are rows


@_registered("documents_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.compile(".k").documents(_table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "value")


@_registered("documents_sniffed", "SELECT n_nationkey, '\"' || n_name || '\"' AS value FROM nation")
def _sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's document is JSON, YAML, TOML, HCL or XML in turn; its format is guessed."""
    forms = [
        "concat('{\"a\": {\"name\": \"', n_name, '\"}}')", "concat('---\na:\n  name: ', n_name, '\n')", "concat('a.name = \"', n_name, '\"\n')",
        "concat('a {\n  name = \"', n_name, '\"\n}\n')", "concat('<a><name>', n_name, '</name></a>')",
    ]
    text = F.get(F.array(*map(F.expr, forms)), F.col("n_nationkey") % 5)
    return api.compile(".a.name").documents(_table(spark, sf_dir, "nation").withColumn("text", text), "text").select("n_nationkey", "value")


@_registered("documents_markdown", "SELECT n_nationkey, '[[\"heading\", \"list\", \"code_block\"], \"' || n_name || '\", 2]' AS value FROM nation")
def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('# ', n_name, '\n\n- one\n- [two][x]\n\n```\ncode\n```\n\n[x]: /y\n')")
    shown = api.compile("{a: .children | map(.type), b: .children[0].children[0].text, c: .children[1].items | length} | values")
    return shown.documents(_table(spark, sf_dir, "nation").withColumn("text", text), "text", "markdown").select("n_nationkey", "value")


@_registered("documents_errors", "SELECT r_regionkey, r_regionkey % 2 = 1 AS failed, CASE WHEN r_regionkey % 2 = 0 THEN '1' END AS value FROM region")
def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "region").withColumn("text", F.expr("if(r_regionkey % 2 = 0, '{\"a\": 1}', '{\"a\": ')"))
    out = api.compile(".a").documents(rows, "text", "json", errors="keep")
    return out.select("r_regionkey", F.col("error").isNotNull().alias("failed"), "value")


# sinks: each customer as a document

SINKS = {
    "json": ("{k: .c_custkey, s: .c_name}", """'{' || chr(10) || '  "c_custkey": ' || c_custkey || ',' || chr(10) || '  "c_name": "' || c_name || '"' || chr(10) || '}'""", True),
    "yaml": ("{k: .c_custkey, s: .c_name}", "'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10)", True),
    "toml": ("{k: .c_custkey, s: .c_name}", """'c_custkey = ' || c_custkey || chr(10) || 'c_name = "' || c_name || '"' || chr(10)""", True),
    "hcl": ("{k: .c_custkey, s: .c_name}", """'c_custkey = ' || c_custkey || chr(10) || 'c_name = "' || c_name || '"' || chr(10)""", True),
    "xml": (".root | {k: .c_custkey, s: .c_name}", "'<root>' || chr(10) || '  <c_custkey>' || c_custkey || '</c_custkey>' || chr(10) || '  <c_name>' || c_name || '</c_name>' || chr(10) || '</root>' || chr(10)", False),
    "csv": (".[0] | {k: .c_custkey, s: .c_name}", "'c_custkey,c_name' || chr(10) || c_custkey || ',' || c_name || chr(10)", False),
    "tsv": (".[0] | {k: .c_custkey, s: .c_name}", "'c_custkey' || chr(9) || 'c_name' || chr(10) || c_custkey || chr(9) || c_name || chr(10)", False),
}


def _sink(fmt: str, query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = render(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), fmt, "document")
        return api.compile(query).documents(texts.withColumn("text", F.col("document")), "text", fmt).select("c_custkey", "document", "value")

    return run


for _fmt, (_query, _text, _typed) in SINKS.items():
    _key = "c_custkey" if _typed else "'\"' || c_custkey || '\"'"
    _registered(f"sink_{_fmt}", f"""SELECT c_custkey, {_text} AS document, '{{"k": ' || {_key} || ', "s": "' || c_name || '"}}' AS value FROM customer""")(_sink(_fmt, _query))


# other ways in

REGIONS = """(SELECT '[' || string_agg('"' || r_name || '"', ', ' ORDER BY r_regionkey) || ']' FROM region)"""


def _regions(spark: SparkSession, sf_dir: str) -> list[dict]:
    return [r.asDict() for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows


def _shown(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "what string, result string")


def _constants(*rows: tuple[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + a.replace("'", "''") + "', " + b + ")" for a, b in rows) + ") t(what, result)"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SHAPE = '[{"r_regionkey": "number", "r_name": "string"}]'


@_registered("calls_on_texts", _constants(("text", REGIONS), ("json", REGIONS), ("value", REGIONS), ("schema", _text(SHAPE)), ("schema of a table", _text(SHAPE)), ("tool query", "(SELECT CAST(count(*) AS VARCHAR) FROM region)"), ("tool schema", _text(SHAPE)), ("tool assert", "'PASS'"), ("assert", "'true'"), ("assert of a table", "'true'"), ("raw", "'AFRICA'")))
def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regions(spark, sf_dir)
    source, names = json.dumps(rows), ". | map(.r_name)"
    compact = lambda text: json.dumps(json.loads(text))
    return _shown(spark, [
        ("text", json.dumps(api.query_text(names, source))), ("json", json.dumps(api.query_json(names, source))), ("value", json.dumps(api.compile(names).value(rows))),
        ("schema", json.dumps(api.infer_schema(rows))), ("schema of a table", json.dumps(api.infer_schema(_table(spark, sf_dir, "region")))),
        ("tool query", api.tool_query(source, ". | length")), ("tool schema", compact(api.tool_schema(source))), ("tool assert", api.tool_assert(source, ". | length > 0")),
        ("assert", str(api.assert_query(". | length > 0", rows)).lower()), ("assert of a table", str(api.assert_query(". | length > 0", _table(spark, sf_dir, "region"))).lower()),
        ("raw", api.query_text(".[0].r_name", source)),
    ])


@_registered("command_line", _constants(("query", REGIONS), ("stdin", "'5'"), ("raw", "'AFRICA'"), ("to csv", "'k' || chr(10) || '0'"), ("format", "'1'"), ("schema", _text(SHAPE)), ("assert true", "'0'"), ("assert false", "'1'"), ("error", "'1'"), ("usage", "'2'")))
def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    import sys

    fd, path = tempfile.mkstemp(suffix=".json")  # the command line reads files of its own machine
    source = json.dumps(_regions(spark, sf_dir))
    with os.fdopen(fd, "w") as out:
        out.write(source)

    def call(*args: str, text: str = "") -> tuple[int, str]:
        shown, before = io.StringIO(), sys.stdin
        sys.stdin = io.StringIO(text)
        try:
            with contextlib.redirect_stdout(shown), contextlib.redirect_stderr(io.StringIO()):
                code = cli.main(list(args))
        finally:
            sys.stdin = before
        return code, shown.getvalue().rstrip("\n")

    try:
        names = json.dumps(json.loads(call(". | map(.r_name)", path)[1]))
        shape = json.dumps(json.loads(call("--schema", path)[1]))
        return _shown(spark, [
            ("query", names), ("stdin", call(". | length", text=source)[1]), ("raw", call("-r", ".[0].r_name", path)[1]), ("to csv", call("-t", "csv", ".[:1] | map({k: .r_regionkey})", path)[1]),
            ("format", call("-f", "yaml", ".a", text="a: 1")[1]), ("schema", shape), ("assert true", str(call("--assert", ". | length == 5", path)[0])),
            ("assert false", str(call("--assert", ". | length == 6", path)[0])), ("error", str(call(".[", path)[0])), ("usage", str(call()[0])),
        ])
    finally:
        os.remove(path)


@_registered("session", _constants(("session", "'5' || chr(10) || 'AFRICA' || chr(10) || 'k' || chr(10) || '0' || chr(10) || 'error: unknown command :x'"), ("complete an operation", "'map map_values max min'"), ("complete a field", "'.r_name .r_regionkey'"), ("complete a command", "'history help'"), ("complete a format", "'toml tsv'")))
def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, shown = _regions(spark, sf_dir), []
    lines = iter([". | length", ":raw", "(.[0]", ").r_name", ":to csv", ".[:1] | map({k: .r_regionkey})", ":x", ":q"])
    cli.session(data, cli.arguments().parse_args([]), read=lambda _: next(lines), show=shown.append)

    def words(text: str) -> str:
        return " ".join(complete(text, len(text), data)[1])

    return _shown(spark, [
        ("session", "\n".join(shown)), ("complete an operation", words(". | m")), ("complete a field", words(".[0].r")),
        ("complete a command", " ".join(sorted(words(":h").split(), reverse=True))), ("complete a format", words(":to t")),
    ])


@_registered("parse_errors", _constants(("unclosed", "'true'"), ("unknown operation", "'did you mean \"filter\"'"), ("bad escape", "'true'"), ("nothing", "'true'"), ("fits", "'false'")))
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fails(text: str) -> str:
        try:
            parse(text)
        except QueryError as e:
            return str("parse error at column" in str(e)).lower()
        return "false"

    try:
        parse(".x | filtr(.a)")
        hint = ""
    except QueryError as e:
        hint = 'did you mean "filter"' if 'did you mean "filter"' in str(e) else str(e)
    return _shown(spark, [("unclosed", fails("(.a")), ("unknown operation", hint), ("bad escape", fails('"\\q"')), ("nothing", fails(". | ")), ("fits", fails(". | first"))])


@_registered("matchers", _constants(("where", "'true'"), ("equals", "'true'"), ("matches", "'true'"), ("has", "'true'"), ("where fails", "'false'"), ("equals fails", "'false'"), ("matches fails", "'false'"), ("has fails", "'false'")))
def _matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _regions(spark, sf_dir)

    def holds(check, *args) -> str:
        try:
            check(data, *args)
        except AssertionError:
            return "false"
        return "true"

    return _shown(spark, [
        ("where", holds(testing.query_where, ". | length == 5")), ("equals", holds(testing.query_equals, ".[0].r_name", "AFRICA")), ("matches", holds(testing.query_matches, ".[0].r_name", "^AF")),
        ("has", holds(testing.query_has, ".[4]")), ("where fails", holds(testing.query_where, ". | length == 6")), ("equals fails", holds(testing.query_equals, ".[0].r_name", "X")),
        ("matches fails", holds(testing.query_matches, ".[0].r_name", "^X")), ("has fails", holds(testing.query_has, ".[9]")),
    ])


@_registered("stream", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter and map over a stream of files; what has arrived is read from its sink."""
    from .streaming import query_stream

    path = _folder(spark, "stream")
    lines = _table(spark, sf_dir, "lineitem")
    lines.write.parquet(f"{path}/in")
    out = query_stream(". | filter(.l_quantity > 49) | map({l_orderkey, l_linenumber})", spark.readStream.schema(lines.schema).parquet(f"{path}/in"))
    running = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
