"""WARC records: a writer, a reader, and the builder of derivatives.

``responses`` makes response records of pages; ``derive`` turns response records
into a metadata record and a plain-text conversion record each. Both refer to
the response by WARC-Refers-To and keep its target URI, date and payload digest
(WARC-Refers-To-Payload-Digest); each record has its own block digest. Record
ids are name-based (of type, source and digest), so a task made again yields the
same records.

One record is one row, its block as bytes, and rows are made where the pages lie, without a shuffle.
``write`` makes files of real WARC: each task streams its records into one ``.warc.gz``,
a gzip member a record, behind a warcinfo record, and renames it into place when it is complete.
``read`` takes such files, or others', apart again, a record at a time; warcinfo records, which speak
of a file, give no rows. Field names are taken in either case and folded lines as one. A digest is
checked if it is there and its algorithm is known; damage raises.

Bodies in chunks or compressed are unpacked for the derivatives, and decoded by the
charset that they name, else as UTF-8 or, where that fails, as Latin-1. A body that is no text has no
conversion record, only metadata. Control characters in addresses are percent-encoded, so no
value can end a field.

A null html is an empty document; a null url gives a record without
WARC-Target-URI. Repeated pages give repeated records with equal ids. Text of any length is
converted whole, in one walk over its tags. Without pages there are no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, file_system, ready

DATE = "2000-01-01T00:00:00Z"
SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, block binary"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Fixed names of elements that end a line, and of those whose content isn't text.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
HIDDEN = ("script", "style", "template", "noscript")
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_LINES = re.compile(r" ?\n[ \n]*")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
#: Bytes of blocks in one batch of rows that are read.
BATCH = 8 << 20
#: Lengths of known digests in bytes.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def digest_holds(field: str | None, block: bytes) -> bool:
    """Whether a digest field fits, in base 32, base 64 or hexadecimal; one of an unknown kind says nothing."""
    name, _, value = (field or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return True
    raw, value = hashlib.new(name, block).digest(), value.strip()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=") or value == base64.b64encode(raw).decode()


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def record_id(*of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(of))}>"


def plain_text(page: str) -> tuple[str, str, list[str]]:
    """Text of a page, its title and its links, in one walk."""
    out: list[str] = []
    links: list[str] = []
    title, at, lower = "", 0, None
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            out.append(page[at:])
            break
        out.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            else:
                out.append("<")
                at = lt + 1
            continue
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end + 1
        name, closing = m[1].lower(), page[lt + 1] == "/"
        if not closing and name == "a":
            href = next((a for a in _ATTRIBUTE.finditer(page[m.end() : end]) if a[1].lower() == "href"), None)
            if href and (link := html.unescape(href[2] or href[3] or href[4] or "").strip()):
                links.append(escaped(link))
        at = end
        if not closing and name in (*HIDDEN, "title"):
            lower = page.lower() if lower is None else lower
            stop = lower.find(f"</{name}", end) if len(lower) == len(page) else page.find(f"</{name}", end)
            stop = len(page) if stop < 0 else stop
            if name == "title":
                title = " ".join(html.unescape(page[end:stop]).split())
            at = page.find(">", stop) + 1 or len(page)
        if name in BLOCKS:
            out.append("\n")
    text = _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(out)).replace("\xa0", " "))).strip()
    return text, title, links


def _row(page_id, kind: str, ident: str, refers: str | None, uri, date: str, content: str, payload: str, block: bytes) -> tuple:
    return page_id, kind, ident, refers, uri, date, content, payload, digest(block), len(block), block


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"page_id": pa.int64(), "content_length": pa.int64(), "block": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(_NAMES, cols, strict=True)], names=_NAMES)


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page_id, url, page in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html")), strict=True):
            body, url = (page or "").encode(), None if url is None else escaped(url)
            payload = digest(body)
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
            rows.append(_row(page_id, "response", record_id("response", url or "", payload), None, url, DATE, "application/http; msgtype=response", payload, block))
        yield _batch(rows)


def responses(pages: DataFrame) -> DataFrame:
    """A response record for each row of ``pages`` (page_id, url, html)."""
    ready(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_responses, SCHEMA)


def unchunked(body: bytes) -> bytes:
    """A body without the marks of its chunks; what doesn't look like chunks stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n > len(body):
            return body
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def unpacked(fields: dict[str, str], body: bytes) -> bytes:
    """The body as it was before it was sent."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            return zlib.decompress(body, 47)  # by its header
        except zlib.error:
            return body
    return body


def decoded_body(content: str, body: bytes) -> str | None:
    """The text of a body, or None if it is none."""
    kind = content.split(";")[0].strip().lower()
    if kind and not (kind.startswith("text/") or kind.endswith(("xml", "json", "javascript"))):
        return None
    found = re.search(r"""charset\s*=\s*["']?([\w.:-]+)""", content, re.I) or re.search(rb"""<meta[^>]{0,200}charset\s*=\s*["']?([\w.:-]+)""", body[:4096], re.I)
    try:
        name = found[1] if found else "utf-8"
        return body.decode(name if isinstance(name, str) else name.decode("ascii"), "replace" if found else "strict")
    except (LookupError, UnicodeDecodeError):
        try:
            return body.decode()
        except UnicodeDecodeError:
            return body.decode("latin-1")


def derivatives(source: dict) -> list[tuple]:
    """The metadata and, if its body is text, the conversion record of a response record."""
    head, _, body = source["block"].partition(b"\r\n\r\n")
    status, *lines = [_CONTROL.sub(" ", x) for x in head.decode("latin-1").split("\r\n")]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    page = decoded_body(fields.get("content-type", ""), unpacked(fields, body))
    text, title, links = plain_text(page) if page is not None else ("", "", [])
    payload, ident = source["payload_digest"] or digest(body), source["record_id"]
    meta = [f"source-status: {status}", *lines, f"title: {escaped(title)}", f"characters: {len(text)}", *(f"outlink: {x}" for x in links)]
    made = [("metadata", "application/warc-fields", "".join(x + "\r\n" for x in meta))]
    if page is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text))
    out = []
    for kind, content, block in made:
        raw = block.encode("utf-8", "replace")
        out.append(_row(source["page_id"], kind, record_id(kind, ident, digest(raw)), ident, source["target_uri"], source["warc_date"], content, payload, raw))
    return out


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([row for source in b.to_pylist() for row in derivatives(source)])


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records among ``records``."""
    ready(records.sparkSession)
    return records.where("warc_type = 'response'").select(_NAMES).mapInArrow(_derive, SCHEMA)


def encoded(r: dict) -> bytes:
    """A record as it stands in a file."""
    digest_field = "WARC-Payload-Digest" if r["refers_to"] is None else "WARC-Refers-To-Payload-Digest"
    fields = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["warc_date"]), ("Content-Type", r["content_type"]), (digest_field, r["payload_digest"]), ("WARC-Block-Digest", r["block_digest"]), ("Content-Length", len(r["block"])), ("X-Page-Id", r["page_id"])]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {escaped(str(v))}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + r["block"] + b"\r\n\r\n"


def decoded(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an uncompressed stream, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"expected a record, got {line[:20]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and last:
                fields[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if not line or len(block) < n:
            raise ValueError("the file ends within a record")
        ident, page = fields.get("warc-record-id"), fields.get("x-page-id", "")
        if not digest_holds(fields.get("warc-block-digest"), block):
            raise ValueError(f"digest of {ident} doesn't match")
        yield {
            "page_id": int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None, "warc_type": fields.get("warc-type"), "record_id": ident, "refers_to": fields.get("warc-refers-to"),
            "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"), "content_type": fields.get("content-type"),
            "payload_digest": fields.get("warc-payload-digest") or fields.get("warc-refers-to-payload-digest"), "block_digest": fields.get("warc-block-digest"), "content_length": n, "block": block,
        }


def _store(path: str):
    """The file system of a path, as executors reach it without Spark, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(records: DataFrame, path: str) -> int:
    """Writes ``records`` as .warc.gz files under ``path``, a URI that all executors reach; how many there are.

    A task made again writes the same file, under a name of its own until it is complete."""
    ready(records.sparkSession)
    job = uuid.uuid4().hex
    _store(path)[0].create_dir(f"{_store(path)[1]}/_temporary/{job}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        task = TaskContext.get()
        name, temp = f"{root}/part-{task.partitionId():05d}-{job}.warc.gz", f"{root}/_temporary/{job}/{task.taskAttemptId()}"
        n, out = 0, None
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out = store.open_output_stream(temp, compression=None)
                    about = b"software: docsieve\r\nformat: WARC File Format 1.1\r\n"
                    head = _row(None, "warcinfo", record_id("warcinfo", job, str(task.partitionId())), None, None, DATE, "application/warc-fields", None, about)
                    out.write(gzip.compress(encoded(dict(zip(_NAMES, head, strict=True))), 6, mtime=0))
                out.write(gzip.compress(encoded(r), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            store.move(temp, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    total = records.select(_NAMES).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    delete(records.sparkSession, f"{path}/_temporary")
    return total


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a .warc or .warc.gz file, or of all in a folder, a task a file.

    Files are streamed. Where only Spark's readers reach them, a file comes as one row, so it must be under 2 GB."""
    ready(spark)
    fs, p = file_system(spark, path)
    names = [s.getPath().toString() for s in fs.listStatus(p) if re.search(r"\.warc(\.gz)?\Z", s.getPath().getName())]
    try:
        _store(path)
        files = spark.createDataFrame([(n, None) for n in names], "path string, content binary").repartition(max(1, len(names)), "path")
    except (pa.ArrowInvalid, OSError):
        files = spark.read.format("binaryFile").load(names).select("path", "content") if names else spark.createDataFrame([], "path string, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if content is None:
                    store, at = _store(name)
                    content = store.open_input_stream(at, compression=None)
                raw = io.BufferedReader(io.BytesIO(content) if isinstance(content, bytes) else content)
                for r in decoded(gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw):
                    if r["warc_type"] != "warcinfo":
                        rows.append(tuple(r[k] for k in _NAMES))
                        size += len(r["block"]) + 1000
                    if size >= BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)

    return files.mapInArrow(run, SCHEMA)
