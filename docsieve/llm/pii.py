"""Personal data in texts, by aggregating weak labels.

Base patterns give spans of e-mail addresses, IP addresses, card numbers and
phone numbers; all of these stay. Looser patterns propose more spans
(mail addresses written with "(at)" and "dot", phone numbers without a country code,
IP addresses of version 6 or with dots in brackets, card numbers parted by dots).
On every proposed or base span four labelers vote personal (1), not (-1) or
abstain (0): the strict pattern, a gazetteer (top-level domains, endings of file names, words
that are no names, issuer digits, reserved networks, dates), the words before it, and what it touches. Expectation-
maximisation over the counts of vote patterns, by kind, estimates how reliable
each is; a logistic classifier of spans is then trained on the posteriors, on
the votes and the span's shape. A proposed span is added if the classifier says so
and no base span overlaps it.

Votes and shape form one of at most CODES numbers, so what is counted, fitted on
the driver and sent back is of fixed size, while the counts cover every span of
every document. Offsets are code points, ends exclusive. A null or empty text
has no spans. Rows are scanned one by one, whatever their doc_id. A text is
scanned whole; each base pattern is matched in time linear in its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ready

KINDS = ["email", "ip", "card", "phone"]
#: kind x strict, gazetteer, context and touching votes x three shapes
CODES = 4 * 3**4 * 3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|\(?0[0-9]{1,4}\)?[\x20/.-]{1,3}[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3})(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])")
_LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", re.I)
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?|\.)[A-Za-z0-9-]{1,63})+", re.I)
#: Top-level domains (besides those of two letters, which are countries), endings of file names, words
#: that stand where a name would, and words that speak for and against a kind.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro museum aero coop jobs mobi travel xyz online site shop app dev cloud tech store blog email example test".split())
FILE_ENDINGS = frozenset("png jpg jpeg gif svg pdf doc docx txt html htm css js py java xml json csv zip gz tar exe log".split())
NO_NAMES = frozenset("the this that these those a an and or of in on to we he she they it you i is are was were be been met look looking arrived arrive stay stayed work works once home der die das le la les un une el los las".split())
CUES = {
    "email": re.compile(r"\b(e-?mail|contact|write|mailto|reach|adresse|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|client|login|gateway)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|credit|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|call|mobile|fax|ring|telefon|téléphone|teléfono)\b", re.I),
}
AGAINST = re.compile(r"\b(version|isbn|issn|section|article|order|invoice|ticket|serial|part|id|no|nr)\W*\Z", re.I)
_DATE = re.compile(r"[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from each @ outwards: what the pattern finds, without its retries on long runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        elif start < at:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS."""
    out: list[list[tuple[int, int]]] = [list(emails(text)), [], [], []]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out[3].append(m.span())
    return out


def proposed(text: str) -> Iterator[tuple[int, int, int]]:
    """Looser spans: kind's number, start, end."""
    low = text.lower()  # the pattern takes either case; with a plain at, only a written dot is taken below
    if "(at)" in low or "[at]" in low or (" at " in low and (" dot " in low or "(dot)" in low or "[dot]" in low)):
        for m in _LOOSE_MAIL.finditer(text):
            if "(" in m[0] or "[" in m[0] or " dot " in m[0].lower():
                yield 0, *m.span()
    if _DIGIT.search(text):
        for m in _LOOSE_PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield 3, *m.span()
        for m in _LOOSE_CARD.finditer(text):
            if luhn(re.sub("[^0-9]", "", m[0])):
                yield 2, *m.span()
        if "[" in text or "(" in text or text.count(":") >= 7:
            for m in _LOOSE_IP.finditer(text):
                if ":" in m[0] or all(int(x) <= 255 for x in re.findall("[0-9]+", m[0])):
                    yield 1, *m.span()


def in_gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        names = [x for x in re.split(r"[^A-Za-z0-9]+", span.lower()) if x not in ("", "at", "dot")]
        if len(names) < 3 or names[-1] in FILE_ENDINGS or names[0] in NO_NAMES or names[-2] in NO_NAMES:
            return -1
        return 1 if names[-1] in TOP_DOMAINS or re.fullmatch("[a-z]{2}", names[-1]) else 0
    if kind == 1:
        return -1 if digits and re.split("[^0-9]+", span)[0].lstrip("0") in ("", "127", "255") and ":" not in span else 0
    if kind == 2:
        return 1 if digits[0] in "3456" else 0
    return -1 if _DATE.match(span) else 1 if span.startswith("+") or "(" in span else 0


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, int, int, int]:
    span, before = text[start:end], text[max(0, start - 40) : start]
    digits = "".join(c for c in span if c in "0123456789")
    gazetteer = in_gazetteer(kind, span, digits)
    cue = CUES[KINDS[kind]].search(before)
    context = -1 if AGAINST.search(before) else 1 if cue else 0
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    touching = -1 if any(c.isalnum() or c in "_/=" for c in around) else 0  # standing alone says little
    return (1 if strict else 0), gazetteer, context, touching


def code(kind: int, v: tuple[int, int, int, int], length: int) -> int:
    out = kind
    for x in v:
        out = out * 3 + x + 1
    return out * 3 + (0 if length < 14 else 1 if length < 24 else 2)


def decode(c: int) -> tuple[int, list[int], int]:
    c, shape = divmod(c, 3)
    v = []
    for _ in range(4):
        c, x = divmod(c, 3)
        v.append(x - 1)
    return c, v[::-1], shape


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<kind:int,start:int,end:int,base:boolean,code:int>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, shas, spans = [[], [], [], []], [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            rows = [(k, s, e, True) for k, found in enumerate(base) for s, e in found]
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in rows).encode()).hexdigest())
            taken = sorted((s, e) for _, s, e, _ in rows)
            at = 0
            for k, s, e in sorted(proposed(text), key=lambda x: x[1:]):
                while at < len(taken) and taken[at][1] <= s:
                    at += 1
                if not any(p < e and s < q for p, q in taken[at : at + 4]):
                    rows.append((k, s, e, False))
            spans.append([{"kind": k, "start": s, "end": e, "base": strict, "code": code(k, votes(text, k, s, e, strict), e - s)} for k, s, e, strict in rows])
            for k in range(4):
                counts[k].append(len(base[k]))
        cols = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.list_(_SPAN))]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCHEMA.split(", ")])


#: Where the estimate starts, with three times the weight of all spans and ten more, so that a labeler isn't turned round; as many are personal as not: P(vote -1, 0, 1 | not personal, personal). A labeler is right in
#: most cases; words that name something else, and letters that touch a span, hardly ever stand at personal data.
START = [[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]
STARTS = [START, START, [[0.6, 0.3, 0.1], [0.02, 0.38, 0.6]], [[0.4, 0.6, 0.0], [0.02, 0.98, 0.0]]]


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 30, starts: list | None = None) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Share of personal spans, P(vote | class) by labeler, and the posterior of each pattern."""
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    x = np.array(keys, int) + 1
    chance, share = np.array(starts or [START] * x.shape[1]) + 1e-6, 0.5
    weight = 3 * (n.sum() + 10)
    prior = weight * chance  # labeler x class x vote + 1
    for _ in range(rounds):
        log = np.stack([np.log(chance[np.arange(x.shape[1])[None], c, x]).sum(1) for c in (0, 1)], 1) + np.log([1 - share, share])
        q = 1 / (1 + np.exp(log[:, 0] - log[:, 1]))
        share = float((n @ q + weight / 2) / (n.sum() + weight))
        for j in range(x.shape[1]):
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                chance[j, c] = np.bincount(x[:, j], weights=w, minlength=3) + prior[j, c]
                chance[j, c] /= chance[j, c].sum()
    return share, chance, dict(zip(keys, q.tolist(), strict=True))


def accepted_codes(counts: dict[int, int]) -> list[int]:
    """Codes that the final classifier takes for personal data."""
    if not counts:
        return []
    rows = []
    for kind in range(4):
        own = {c: n for c, n in counts.items() if decode(c)[0] == kind}
        patterns: dict[tuple[int, ...], float] = {}
        for c, n in own.items():
            v = tuple(decode(c)[1])
            patterns[v] = patterns.get(v, 0) + n
        if patterns:
            _, _, posterior = reliabilities(patterns, starts=STARTS)
            rows += [(c, n, posterior[tuple(decode(c)[1])]) for c, n in own.items()]

    def features(c: int) -> np.ndarray:
        kind, v, shape = decode(c)
        out = np.zeros(1 + 4 + 12 + 3)
        out[0] = out[1 + kind] = out[17 + shape] = 1
        for j, x in enumerate(v):
            out[5 + 3 * j + x + 1] = 1
        return out

    x = np.stack([features(c) for c, _, _ in rows])
    n = np.array([n for _, n, _ in rows], float)
    y = np.array([q for _, _, q in rows])
    n = np.log1p(n) / np.log1p(n).sum()
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (n * (p - y)) + 1e-3 * w)
    return sorted(c for (c, _, _), p in zip(rows, 1 / (1 + np.exp(-x @ w)), strict=True) if p >= 0.5 and not math.isnan(p))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; a row for each row of ``docs``."""
    spark = docs.sparkSession
    ready(spark)
    out = Scratch(spark, "pii")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _SCHEMA)
    rows = out.table(rows, "spans")
    counts = {r["code"]: r["n"] for r in rows.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}
    good = F.array(*map(F.lit, accepted_codes(counts) or [-1]))
    kept = F.filter("spans", lambda s: s["base"] | F.array_contains(good, s["code"]))
    kept = F.array_sort(kept, lambda a, b: F.when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["start"] - b["start"]))
    names = F.array(*map(F.lit, KINDS))
    return rows.withColumn("_k", kept).select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256",
        F.array_join(F.transform("_k", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",").alias("spans"),
        (F.size("_k") - F.col("n_email") - F.col("n_ip") - F.col("n_card") - F.col("n_phone")).cast("long").alias("n_added"),
    )
