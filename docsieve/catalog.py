"""Registered queries of the language, each with the same in SQL.

A query is over a whole table. ``on`` takes the table as the list, ``each`` takes
each row as a document and names the columns of the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, surfaces


@dataclass(frozen=True)
class Entry:
    table: str
    text: str
    sql: str
    prepare: Callable[[DataFrame], DataFrame] | None = None
    scalar: str | None = None  # the name of the only value

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        out = api.query(self.text, self.prepare(df) if self.prepare else df)
        return out.withColumnRenamed("value", self.scalar) if self.scalar else out


def _props(df: DataFrame) -> DataFrame:
    """The JSON text of an event as a map."""
    return df.select("event_id", "event_type", F.from_json("props", "map<string,bigint>").alias("props"))


def _lists(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


ENTRIES = {
    # navigation, scalars
    "filter_map_sort": Entry("lineitem", ". | filter(.l_quantity > 45) | map({l_orderkey, l_linenumber, l_quantity}) | sort_by(.l_orderkey)", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45"),
    "identity": Entry("region", ".", "SELECT * FROM region"),
    "arithmetic": Entry("lineitem", ". | map({l_orderkey, l_linenumber, net: .l_extendedprice * (1 - .l_discount), whole: .l_linenumber * 2 + 1, rest: .l_orderkey % 7, less: -.l_linenumber})", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, CAST(l_linenumber * 2 + 1 AS BIGINT) AS whole, l_orderkey % 7 AS rest, -l_linenumber AS less FROM lineitem"),
    "division": Entry("part", ". | map({p_partkey, q: .p_retailprice / .p_size, half: .p_size / 2})", "SELECT p_partkey, p_retailprice / p_size AS q, p_size / 2 AS half FROM part"),
    "comparison": Entry("orders", ". | map({o_orderkey, big: .o_totalprice >= 300000, small: .o_totalprice <= 1000, open: .o_orderstatus == \"O\", other: .o_orderstatus != \"F\"})", "SELECT o_orderkey, o_totalprice >= 300000 AS big, o_totalprice <= 1000 AS small, o_orderstatus = 'O' AS open, o_orderstatus <> 'F' AS other FROM orders"),
    "logic": Entry("lineitem", ". | filter((.l_quantity > 45 && .l_discount < 0.05) || !(.l_tax > 0.01)) | map({l_orderkey, l_linenumber})", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND l_discount < 0.05) OR NOT (l_tax > 0.01)"),
    "conditional": Entry("orders", ". | map({o_orderkey, band: if .o_totalprice > 300000 then \"high\" else if .o_totalprice > 100000 then \"middle\" else \"low\"})", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders"),
    "interpolation": Entry("customer", '. | map({c_custkey, tag: "\\(.c_name):\\(.c_custkey) in \\(.c_mktsegment)"})', "SELECT c_custkey, c_name || ':' || c_custkey || ' in ' || c_mktsegment AS tag FROM customer"),
    "concatenation": Entry("nation", '. | map({n_nationkey, s: .n_name + "/" + .n_name})', "SELECT n_nationkey, n_name || '/' || n_name AS s FROM nation"),
    "absent_field": Entry("nation", ". | map({n_nationkey, none: (.missing | length) == null})", "SELECT n_nationkey, true AS none FROM nation"),
    "object_nested": Entry("supplier", ". | map({s_suppkey, a: {b: .s_acctbal}.b})", "SELECT s_suppkey, s_acctbal AS a FROM supplier"),
    "string_slice": Entry("documents", ". | map({doc_id, head: .text[0:20], tail: .text[-5:], n: .text | length})", "SELECT doc_id, substr(text, 1, 20) AS head, right(text, 5) AS tail, length(text) AS n FROM documents"),
    "index_row": Entry("orders", "(. | sort_by(.o_orderkey))[3].o_totalprice", "SELECT o_totalprice AS v FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 3", None, "v"),
    # pipeline operations on the relation
    "top_k": Entry("orders", "(. | sort_by(.o_totalprice) | reverse)[:10] | map({o_orderkey, o_totalprice})", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10"),
    "slice_middle": Entry("customer", "(. | sort_by(.c_custkey))[100:150] | map({c_custkey, c_name})", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100"),
    "slice_end": Entry("customer", "(. | sort_by(.c_custkey))[-7:] | map({c_custkey})", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7"),
    "sort_values": Entry("customer", ". | map(.c_acctbal) | sort", "SELECT c_acctbal AS v FROM customer", None, "v"),
    "group_fused": Entry("lineitem", ". | group_by(.l_returnflag) | map({k: .key, n: .values | length, q: .values | map(.l_quantity) | sum, lo: .values | map(.l_extendedprice) | min, hi: .values | map(.l_extendedprice) | max, lines: .values | map(.l_linenumber) | sum})", "SELECT l_returnflag AS k, count(*) AS n, sum(l_quantity) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1"),
    "group_filtered": Entry("orders", '. | group_by(.o_orderpriority) | map({k: .key, open: .values | filter(.o_orderstatus == "O") | length, all: .values | length})', "SELECT o_orderpriority AS k, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) AS all FROM orders GROUP BY 1".replace("AS all", 'AS "all"')),
    "group_having": Entry("orders", ". | group_by(.o_custkey) | filter(.values | length > 15) | map({k: .key, n: .values | length})", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "group_two_keys": Entry("lineitem", ". | group_by({f: .l_returnflag, s: .l_linestatus}) | map({f: .key.f, s: .key.s, n: .values | length})", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "group_raw": Entry("customer", ". | group_by(.c_nationkey) | map({k: .key, first: .values | map(.c_custkey) | sort | first, n: .values | unique_by(.c_mktsegment) | length})", "SELECT c_nationkey AS k, min(c_custkey) AS first, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1"),
    "group_count": Entry("orders", ". | group_by(.o_custkey) | length", "SELECT count(DISTINCT o_custkey) AS v FROM orders", None, "v"),
    "unique": Entry("orders", ". | map(.o_orderstatus) | unique", "SELECT DISTINCT o_orderstatus AS v FROM orders", None, "v"),
    "unique_count": Entry("lineitem", ". | map(.l_partkey) | unique | length", "SELECT count(DISTINCT l_partkey) AS v FROM lineitem", None, "v"),
    "unique_by": Entry("customer", ". | sort_by(.c_custkey) | unique_by(.c_mktsegment) | map({c_custkey, c_mktsegment})", "SELECT min(c_custkey) AS c_custkey, c_mktsegment FROM customer GROUP BY 2"),
    "unique_by_sorted_desc": Entry("customer", ". | sort_by(-.c_custkey) | unique_by(.c_mktsegment) | map({c_custkey, c_mktsegment})", "SELECT max(c_custkey) AS c_custkey, c_mktsegment FROM customer GROUP BY 2"),
    "unique_by_sorted_text": Entry("customer", ". | sort_by(.c_name) | reverse | sort_by(.c_nationkey) | unique_by(.c_mktsegment) | map({c_custkey, c_mktsegment})", "SELECT arg_max(c_custkey, c_name) AS c_custkey, c_mktsegment FROM customer c WHERE c_nationkey = (SELECT min(c_nationkey) FROM customer d WHERE d.c_mktsegment = c.c_mktsegment) GROUP BY 2"),
    "group_by_sorted_desc": Entry("customer", ". | sort_by(-.c_custkey) | group_by(.c_nationkey) | map({k: .key, first: .values[0].c_custkey, last: .values[-1].c_custkey})", "SELECT c_nationkey AS k, max(c_custkey) AS first, min(c_custkey) AS last FROM customer GROUP BY 1"),
    "group_order": Entry("customer", "(. | sort_by(-.c_custkey) | group_by(.c_nationkey) | map(.key))[:5]", "SELECT c_nationkey AS v FROM customer GROUP BY 1 ORDER BY max(c_custkey) DESC LIMIT 5", None, "v"),
    "object_with_reversed_list": Entry("nation", '{a: "\\(. | sort_by(.n_nationkey) | reverse | map(.n_nationkey))", n: . | length}', "SELECT '[' || string_agg(CAST(n_nationkey AS VARCHAR), ', ' ORDER BY n_nationkey DESC) || ']' AS a, count(*) AS n FROM nation"),
    "group_by_map_key": Entry("events", ". | group_by(.props) | length", "SELECT count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS v FROM events", _props, "v"),
    "slice_open_end": Entry("orders", "(. | sort_by(.o_orderkey))[25:] | map({o_orderkey})", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 25"),
    "flatten": Entry("embeddings", ". | map(.embedding[0:3]) | flatten | map({x: .})", "SELECT unnest(list_slice(CAST(embedding AS DOUBLE[]), 1, 3)) AS x FROM embeddings", _lists),
    "first_last": Entry("supplier", "{a: . | sort_by(.s_suppkey) | first, b: . | sort_by(.s_suppkey) | last} | {a: .a.s_name, b: .b.s_name}", "SELECT (SELECT s_name FROM supplier ORDER BY s_suppkey LIMIT 1) AS a, (SELECT s_name FROM supplier ORDER BY s_suppkey DESC LIMIT 1) AS b"),
    "multi_aggregate": Entry("orders", "{n: . | length, low: . | map(.o_totalprice) | min, high: . | map(.o_totalprice) | max, keys: . | map(.o_custkey) | sum, open: . | filter(.o_orderstatus == \"O\") | length}", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum(o_custkey) AS BIGINT) AS keys, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders"),
    "average": Entry("part", ". | map(.p_size) | avg", "SELECT avg(p_size) AS v FROM part", None, "v"),
    "length_compare": Entry("orders", ". | length > 100", "SELECT count(*) > 100 AS v FROM orders", None, "v"),
    "has_row": Entry("region", ". | has(4)", "SELECT count(*) > 4 AS v FROM region", None, "v"),
    "keys_of_rows": Entry("region", ". | keys", "SELECT CAST(range AS BIGINT) AS v FROM range((SELECT count(*) FROM region))", None, "v"),
    # the column plane
    "list_fold": Entry("embeddings", ". | map({vec_id, n: .embedding | length, lo: .embedding | min, hi: .embedding | max, pos: .embedding | filter(. > 0) | length})", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(len([x FOR x IN embedding IF x > 0]) AS BIGINT) AS pos FROM embeddings", _lists),
    "list_index": Entry("embeddings", ". | map({vec_id, a: .embedding[0], z: .embedding[-1], none: .embedding[9999]})", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[-1] AS DOUBLE) AS z, CAST(NULL AS DOUBLE) AS none FROM embeddings", _lists),
    "list_sort": Entry("embeddings", ". | map({vec_id, top: .embedding | sort_by(-.) | first, low: .embedding | sort | first, back: .embedding | reverse | first})", "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(embedding[-1] AS DOUBLE) AS back FROM embeddings", _lists),
    "list_group": Entry("embeddings", ". | map({vec_id, n: .embedding | group_by(. > 0) | length, signs: .embedding | map(. > 0) | unique | length})", "SELECT vec_id, CAST(len(list_distinct([x > 0 FOR x IN embedding])) AS BIGINT) AS n, CAST(len(list_distinct([x > 0 FOR x IN embedding])) AS BIGINT) AS signs FROM embeddings", _lists),
    "map_has": Entry("events", '. | map({event_id, k: .props.k, has: .props | has("k"), n: .props | length, none: .props | has("zz")})', "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has, CAST(len(json_keys(props)) AS BIGINT) AS n, false AS none FROM events", _props),
    "map_keys_values": Entry("events", ". | map({event_id, key: .props | keys | first, value: .props | values | first})", "SELECT event_id, json_keys(props)[1] AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events", _props),
    "map_entries": Entry("events", ". | map({event_id, v: .props | to_entries | filter(.value > 50) | from_entries | length})", "SELECT event_id, CAST(CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 1 ELSE 0 END AS BIGINT) AS v FROM events", _props),
    "map_values_op": Entry("events", ". | map({event_id, d: (.props | map_values(. * 2)).k, f: .props | filter_values(. > 50) | length, g: .props | filter_keys(. == \"k\") | length})", "SELECT event_id, 2 * CAST(json_extract(props, '$.k') AS BIGINT) AS d, CAST(CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 1 ELSE 0 END AS BIGINT) AS f, CAST(1 AS BIGINT) AS g FROM events", _props),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return ENTRIES | surfaces.queries()


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in ENTRIES.items()} | surfaces.oracle_sql()
