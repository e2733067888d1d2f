"""Removal of boilerplate lines by their frequency on a site.

A line's frequency is the number of the site's pages that contain it, divided by
the number of pages of the site. Lines over ``ratio`` that are on at least
``pages`` pages are dropped wherever they stand on that site.

Lines are counted by (site, 64-bit hash), once a page, with map-side combine, so
a site with a third of all pages spreads over all tasks. A page with m lines
can hold at most m / ratio boilerplate lines of its site on average, so what is
left for a site is small, and is joined to its pages as one array: broadcast if
all arrays together have at most ``BYTES`` bytes, which is measured, or else by a join
in which the pages of sites with over one in 4096 of all pages are dealt over many tasks.

``RATIO`` is a tenth of the pages: text that is written for one page seldom stands on every tenth.
``PAGES`` is the least support at which a share says something: a line on two
pages may be a copied page. From there on the ratio alone decides, on sites of any size.

Pages without a site (null) are no site and stay as they are. A null text stays
null; an empty one has no lines. Lines without a word are never dropped.
Repeated rows count as pages of their own. A row's other columns are held
together, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, split_join

RATIO, PAGES = 0.1, 3
#: Bytes of boilerplate lines' hashes and sites that may be broadcast.
BYTES = 32 << 20


def _split(docs: DataFrame, site: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col(site).alias("site"), F.col("text").cast("string").alias("text"))


def boilerplate(docs: DataFrame, site: str = "source", ratio: float = RATIO, pages: int = PAGES) -> tuple[DataFrame, DataFrame | None]:
    """site, lines (hashes of its boilerplate lines) for each site that has any; and the sites with a large share of all pages."""
    out = Scratch(docs.sparkSession, "lines")
    rows = _split(docs, site).where("site is not null")
    totals = out.table(rows.groupBy("site").agg(F.count("*").alias("n")), "totals")
    hot = hot_keys(totals, "site")
    lines = F.array_distinct(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x)))
    counts = rows.select("site", F.explode(lines).alias("line")).groupBy("site", "line").agg(F.count("*").alias("on")).where(F.col("on") >= pages)
    often = split_join(counts, totals, ["site"], hot, "line").where(F.col("on") > ratio * F.col("n"))
    return out.table(often.groupBy("site").agg(F.collect_set("line").alias("lines")), "boilerplate"), hot


def drop_lines(docs: DataFrame, site: str = "source", ratio: float = RATIO, pages: int = PAGES) -> DataFrame:
    """row (of ``docs``), the text without the boilerplate, and n_lines and n_dropped: how many there were and went."""
    found, hot = boilerplate(docs, site, ratio, pages)
    size = found.agg(F.sum(8 * F.size("lines") + 64 + F.length(F.col("site").cast("string")))).first()[0] or 0
    rows = _split(docs, site)
    if size <= BYTES:
        joined = rows.join(F.broadcast(found), "site", "left")
    else:
        joined = split_join(rows, found.hint("merge"), ["site"], hot, "text", "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("lines").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("lines", F.xxhash64(x))))
    joined = joined.withColumn("kept", kept).withColumn("n_lines", F.when(F.length("text") > 0, F.size(lines)).otherwise(0).cast("long"))
    joined = joined.withColumn("n_dropped", F.when(F.col("lines").isNull() | F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size("kept")).cast("long"))
    return joined.select("row", F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"), "n_lines", "n_dropped")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, for each row."""
    return drop_lines(docs.select("doc_id", "source", "text")).select("row.doc_id", "n_lines", "n_dropped", "text")


def cleaned(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars, if there, follows the text."""
    out = drop_lines(docs)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


#: The same for DuckDB.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT d.doc_id, d.source, i AS pos, string_split(d.text, chr(10))[i] AS line
  FROM documents d, UNNEST(range(1, len(string_split(d.text, chr(10))) + 1)) AS u(i)
), totals AS (SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL GROUP BY source),
counts AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM lines
  WHERE source IS NOT NULL AND regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line
), often AS (SELECT c.source, c.line FROM counts c JOIN totals t USING (source) WHERE n >= {PAGES} AND n > {RATIO} * total),
marked AS (SELECT l.*, o.line IS NOT NULL AS gone FROM lines l LEFT JOIN often o ON l.source = o.source AND l.line = o.line),
sums AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN length(d.text) > 0 THEN coalesce(s.n_lines, 0) ELSE 0 END AS n_lines,
       coalesce(s.n_dropped, 0) AS n_dropped, CASE WHEN coalesce(s.n_dropped, 0) > 0 THEN s.text ELSE d.text END AS text
FROM documents d LEFT JOIN sums s USING (doc_id)
"""
