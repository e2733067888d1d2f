"""Secrets in texts, on DataFrame functions only.

Three patterns give the base spans. Beyond them, tokens of letters, digits and
``+/_=-`` are scored by two character Markov models, one of random strings and
one of ordinary identifiers: the log-likelihood ratio of the token's character
pairs. Both are trained from labelled samples (``samples``; any table of
``token``, ``is_random`` will do), by counting pairs in Spark; what reaches the
driver is a table of at most 67 x 67 numbers, which becomes a constant of the
plan. A token is a span of kind ``random`` if its ratio reaches ``LEAST`` and it
overlaps no base span. The given samples (``samples``) are digests, and identifiers of two kinds:
names that Python's standard library defines (``library_names``, one in five is held out
for tests), and words of four languages joined in the usual ways.

Offsets are code points; nothing but expressions on the row itself is used, so
there is no shuffle. A null or empty text has no spans. Rows are scanned one by
one, whatever their doc_id, and a text of any length is scanned whole.
"""

from __future__ import annotations

import math
import zlib
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of base spans, in the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 24 or more are what is left of all runs once shorter ones are dropped.
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Natural-logarithm units by which "random" must be likelier than "identifier", over all and by character pair.
LEAST, LEAST_EACH = 8.0, 0.25
_BLOCK = 64

#: Words of which labelled identifiers are made.
WORDS = (
    "user name account message request response handler manager service client server config option value index "
    "table column record number string format buffer stream reader writer parser builder factory session context "
    "create update delete insert select filter reduce process schedule validate normalize authorization connection "
    "the and that which there this other were their about would these into first after where most between through "
    "nicht eine sich auch wird haben einer werden oder durch verbindung einstellung benutzer nachricht verwaltung "
    "les des une dans pour qui sur avec sont comme tout mais nous leur utilisateur parametre connexion fonction "
    "los las para como pero sus esta cuando muy sin sobre tambien usuario mensaje configuracion informacion "
    "http https www org index html page image static content thread worker module package version release internal"
).split()


#: Modules of the standard library whose names are labelled identifiers.
MODULES = "argparse ast asyncio base64 calendar collections concurrent.futures configparser csv ctypes datetime decimal difflib dis email.message functools hashlib html.parser http.client http.cookiejar http.server importlib.machinery inspect io ipaddress itertools json locale logging logging.handlers mailbox multiprocessing.managers os pathlib pickle platform queue random re sched select shutil signal smtplib socket socketserver sqlite3 ssl statistics string subprocess sysconfig tarfile tempfile textwrap threading timeit tokenize traceback types typing unittest unittest.mock urllib.parse urllib.request uuid warnings wave weakref xml.dom.minidom xml.sax.handler zipfile".split()


@cache
def library_names(held_out: bool = False) -> tuple[str, ...]:
    """Names of six or more characters in MODULES and their classes; those held out are every fifth by a checksum."""
    import importlib

    found = set()
    for m in MODULES:
        module = importlib.import_module(m)
        found.update(dir(module))
        for x in vars(module).values():
            if isinstance(x, type):
                found.update(dir(x))
    names = (n for n in found if len(n) >= 6 and all(c in ALPHABET for c in n))
    return tuple(sorted(n for n in names if (zlib.crc32(n.encode()) % 5 == 0) == held_out))


def samples(spark: SparkSession, size: int = 4000, held_out: bool = False) -> DataFrame:
    """Labelled tokens (token, is_random): ``size`` digests, ``size`` joined words and the library's names, the same
    each time. Those held out have other digests, other joins and the other names.

    Random ones are digests in three alphabets; joined words are two to four in the usual
    ways (snake, camel, kebab, path, none, constant)."""
    seed = "held" if held_out else "sample"
    ids = spark.range(size)
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    random = ids.select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 4 == 1, F.substring(F.base64(F.unhex(digest)), 1, 40))
        .when(F.col("id") % 4 == 2, F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""))
        .otherwise(F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 32)))
        .alias("token"),
        F.lit(True).alias("is_random"),
    )
    words = F.split(F.lit(" ".join(WORDS)), " ")

    def word(k: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64(F.col("id"), F.lit(k + 4 * held_out)), F.lit(len(WORDS))).cast("int"))

    parts = F.slice(F.array(*map(word, range(4))), 1, (2 + F.col("id") % 3).cast("int"))
    joined = [
        F.array_join(parts, "_"),
        F.array_join(F.transform(parts, F.initcap), ""),
        F.array_join(parts, "-"),
        F.array_join(parts, "/"),
        F.array_join(parts, ""),
        F.upper(F.array_join(parts, "_")),
        F.concat(F.array_join(parts, "_"), F.lit("_"), (F.col("id") % 100).cast("string")),
    ]
    style = F.get(F.array(*joined), (F.col("id") % len(joined)).cast("int"))
    library = spark.range(1).select(F.explode(F.split(F.lit(" ".join(library_names(held_out))), " ")).alias("token"), F.lit(False))
    return random.union(ids.select(style, F.lit(False))).union(library)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios by pair of characters: entry ``len(ALPHABET) * i + j``; add-one-half smoothing."""
    n = len(ALPHABET)
    chars = F.filter(F.split("token", ""), lambda c: c != "")
    pairs = (
        labelled.where("token is not null and length(token) > 1").select("is_random", chars.alias("c"))
        .select("is_random", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> struct(get(c, i - 1) as a, get(c, i) as b))")).alias("p"))
        .groupBy("is_random", F.instr(F.lit(ALPHABET), F.col("p.a")).alias("a"), F.instr(F.lit(ALPHABET), F.col("p.b")).alias("b"))
        .count().where("a > 0 and b > 0").collect()
    )
    counts = {True: [0.5] * (n * n), False: [0.5] * (n * n)}
    for r in pairs:
        counts[r["is_random"]][(r["a"] - 1) * n + r["b"] - 1] += r["count"]
    out = []
    for i in range(n):
        total = {k: sum(v[i * n : (i + 1) * n]) for k, v in counts.items()}
        out += [math.log(counts[True][i * n + j] / total[True]) - math.log(counts[False][i * n + j] / total[False]) for j in range(n)]
    return out


def _starts(pieces: str, matches: str) -> str:
    """SQL: where each match begins, given the pieces between them: prefix sums over blocks, in near-linear time."""
    steps = f"transform({matches}, (m, k) -> length(get({pieces}, k)) + if(k > 0, length(get({matches}, k - 1)), 0))"
    return f"""transform(array({steps}), s -> transform(array(
        aggregate(sequence(0, cast((size(s) - 1) / {_BLOCK} as int)), array(0), (sums, b) -> array_append(sums, element_at(sums, -1) + aggregate(slice(s, b * {_BLOCK} + 1, {_BLOCK}), 0, (x, y) -> x + y)))
      ), sums -> transform(s, (x, k) -> get(sums, cast(floor(k / {_BLOCK}) as int)) + aggregate(slice(s, cast(floor(k / {_BLOCK}) as int) * {_BLOCK} + 1, k % {_BLOCK} + 1), 0, (x, y) -> x + y)))[0])[0]"""


_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _found(df: DataFrame, kind: str, rank: int, pattern: str, needed: tuple[str, ...]) -> DataFrame:
    """Looks only in texts that hold one of the strings ``needed``, without which there is no match. Adds ``_s_<kind>``: all matches (start, rank, end, kind) and, for judging them, their texts in ``_m_<kind>``."""
    found = F.regexp_extract_all("_s_text", F.lit(pattern), F.lit(0))
    if needed:
        holds = reduce(lambda a, b: a | b, (F.contains(F.col("_s_text"), F.lit(x)) for x in needed))
        found = F.when(holds, found).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(f"_m_{kind}", found)
    df = df.withColumn(f"_p_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("_s_text", pattern, -1)))
    df = df.withColumn(f"_a_{kind}", F.expr(f"if(size(_m_{kind}) > 0, {_starts(f'_p_{kind}', f'_m_{kind}')}, array())"))
    return df.withColumn(
        f"_s_{kind}",
        F.expr(f"cast(transform(_m_{kind}, (m, k) -> struct(get(_a_{kind}, k) as start, {rank} as rank, get(_a_{kind}, k) + length(m) as end, '{kind}' as kind)) as {_SPAN})"),
    ).drop(f"_p_{kind}", f"_a_{kind}")


def _kept(df: DataFrame, kind: str, holds) -> DataFrame:
    """Keeps the spans whose text ``holds``."""
    spans = F.filter(F.zip_with(f"_s_{kind}", f"_m_{kind}", lambda s, m: F.when(holds(m), s)), lambda s: s.isNotNull())
    return df.withColumn(f"_s_{kind}", spans.cast(_SPAN)).drop(f"_m_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, ratios: list[float] | None = None, least: float = LEAST, least_each: float = LEAST_EACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random; a row for each row of ``docs``."""
    ratios = ratios or train(samples(docs.sparkSession))
    n = len(ALPHABET)
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_s_text"))
    for rank, (kind, pattern, needed) in enumerate([("assign", ASSIGN, (":", "=")), ("access", ACCESS, ("AKIA",)), ("hex", HEX, ()), ("random", TOKEN, ())]):
        df = _found(df, kind, rank, pattern, needed)
    df = df.drop("_s_text")
    df = _kept(df, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    df = _kept(df, "access", lambda m: F.length(m) >= 20)
    df = _kept(df, "hex", lambda m: F.length(m) >= 24)

    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")  # folded to a constant

    def random(m: Column) -> Column:
        codes = F.transform(F.filter(F.split(m, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        each = F.transform(F.array(codes), lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, i: s + F.get(table, F.get(c, i - 1) * n + F.get(c, i))))
        total = F.get(each, 0)
        return (total >= least) & (total >= least_each * (F.length(m) - 1))

    df = _kept(df, "random", random)
    df = df.withColumn("_s_base", F.sort_array(F.concat("_s_assign", "_s_access", "_s_hex")))
    df = df.withColumn("_s_random", F.filter("_s_random", lambda r: ~F.exists("_s_base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))
    return df.select(
        "doc_id",
        *(F.size(f"_s_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(F.col("_s_base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("_s_base", "_s_random"))).alias("spans"),
        F.size("_s_random").cast("long").alias("n_random"),
    )
