import odd
import pytest
from pyspark.sql import functions as F

from docsieve.llm import common, queries, sharding, warc


@pytest.fixture
def folder(spark):
    import uuid

    return f"{common.shared_dir(spark)}/{uuid.uuid4().hex}"


def by_hand(raw):
    """Another reader: whole file, headers by the email package."""
    import email.parser

    out = []
    while raw.strip():
        head, _, rest = raw.lstrip(b"\r\n").partition(b"\r\n\r\n")
        version, _, lines = head.partition(b"\r\n")
        fields = dict(email.parser.BytesParser().parsebytes(lines).items())
        n = int(fields["Content-Length"])
        assert version == b"WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        raw = rest[n + 4 :]
    return out


def test_warc_round_trip(spark, folder):
    import gzip
    from pathlib import Path

    rows = [(1, "http://a/x", "<html><head><title>T &amp; u</title><style>p{}</style></head><body><!-- c --><p>One<br>two <b>b</b></p><script>var a='<p>';</script><a href='/l'>link</a> 1 < 2</body>"), (2, None, None), (None, "u", ""), (1, "http://a/x", "<p>" + "w " * 100_000), (5, "é", "<!-- open"), (6, "u", "<b"), (7, "http://e/\r\nX: y", "<A data-href=no HREF=/yes>z</A><a HREF = 'a&#10;b'>q</a>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, block string")
    source = warc.responses(pages)
    made = warc.derive(source)
    assert made.count() == 2 * len(rows) and warc.derive(source.limit(0)).count() == 0 and warc.responses(pages.limit(0)).count() == 0
    everything = source.union(made)
    assert warc.write(everything, folder) == 3 * len(rows)
    assert sorted(map(str, warc.read(spark, folder).collect())) == sorted(map(str, everything.collect()))
    by_id = {r["record_id"]: r for r in source.collect()}
    for r in made.collect():
        s = by_id[r["refers_to"]]
        assert (r["target_uri"], r["warc_date"], r["payload_digest"]) == (s["target_uri"], s["warc_date"], s["payload_digest"])
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"])
    text, title, links = warc.plain_text(rows[0][2])
    assert (text, title, links) == ("One\ntwo b\nlink 1 < 2", "T & u", ["/l"]) and warc.plain_text(rows[6][2])[2] == ["/yes", "a%0Ab"]
    files = sorted(Path(folder.removeprefix("file://")).iterdir())
    assert all(f.name.endswith((".warc.gz", ".crc")) for f in files)
    found = [x for f in files if f.name.endswith(".gz") for x in by_hand(gzip.decompress(f.read_bytes()))]
    assert sum(h["WARC-Type"] == "warcinfo" for h, _ in found) == sum(f.name.endswith(".gz") for f in files)
    assert sorted((h["WARC-Record-ID"], b) for h, b in found if h["WARC-Type"] != "warcinfo") == sorted((r["record_id"], bytes(r["block"])) for r in everything.collect())
    warc.write(everything.limit(0), folder + "-none")
    assert warc.read(spark, folder + "-none").count() == 0


def test_warc_of_others(spark, folder):
    """Records without digests, with other ones, folded and odd fields, Latin-1, binary, chunked and compressed bodies; plain and gzip."""
    import gzip
    import zlib
    from pathlib import Path

    packed = zlib.compressobj(9, zlib.DEFLATED, 31)
    packed = packed.compress("<p>zip é</p>".encode()) + packed.flush()
    http = b"HTTP/1.1 200 OK\r\n%s\r\n\r\n%s"
    blocks = [
        http % (b"Content-Type: text/html; charset=ISO-8859-1", "<title>caf\xe9</title><p>na\xefve".encode("latin-1")), http % (b"Content-Type: image/png", bytes(range(256))),
        http % (b"content-type: text/html\r\nTransfer-Encoding: chunked", b"5\r\n<p>on\r\n2;x=y\r\ne \r\n0\r\n\r\n"), http % (b"Content-Encoding: gzip", packed), http % (b"X: y", b"<p>\xff plain"),
    ]
    extra = [b"", b"warc-block-digest: sha256:" + __import__("hashlib").sha256(blocks[1]).hexdigest().encode() + b"\r\n", b"WARC-Block-Digest: crc9:zzz\r\n", b"X-Long: a\r\n  b\r\n", b"WARC-Payload-Digest:md5:q\r\n"]
    records = [b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, e, len(b), b) for k, (e, b) in enumerate(zip(extra, blocks, strict=True))]
    at = Path(folder.removeprefix("file://"))
    at.mkdir()
    (at / "a.warc").write_bytes(b"".join(records))
    (at / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (at / "c.txt").write_bytes(b"no")
    found = warc.read(spark, folder)
    assert sorted((r["record_id"], bytes(r["block"])) for r in found.collect()) == sorted([(f"<urn:{k}>", b) for k, b in enumerate(blocks)] * 2)
    made = warc.derive(found.where("page_id is null")).collect()
    texts = {r["refers_to"]: bytes(r["block"]).decode() for r in made if r["warc_type"] == "conversion"}
    assert texts == {"<urn:0>": "naïve", "<urn:2>": "one", "<urn:3>": "zip é", "<urn:4>": "ÿ plain"}
    meta = {r["refers_to"]: bytes(r["block"]).decode() for r in made if r["warc_type"] == "metadata"}
    assert len(meta) == 5 and "title: café\r\n" in meta["<urn:0>"] and "image/png" in meta["<urn:1>"]


def test_warc_damage():
    import io

    raw = warc.encoded(dict(zip(warc._NAMES, warc._row(1, "response", "<i>", None, "u", "d", "c", "sha1:x", b"block"), strict=True)))
    assert [r["block"] for r in warc.decoded(io.BytesIO(raw * 2))] == [b"block", b"block"]
    for damaged, message in ((raw.replace(b"block\r\n", b"BLOCK\r\n"), "digest"), (raw[:-7], "ends within"), (b"x" + raw, "expected a record")):
        with pytest.raises(ValueError, match=message):
            list(warc.decoded(io.BytesIO(damaged)))


def test_sharding(spark, folder):
    store = sharding.Store(spark, folder, target=200_000, fan=3, small=20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = store.append(docs.repartition(12))
    assert first.version == 1 and len(first.shards) == 12
    store.append(docs.limit(0))
    store.append(docs.limit(30))
    last = store.compact()
    assert last.version > 3 and len(last.shards) < 12 and all(s["bytes"] <= 1.5 * 200_000 for s in last.shards)
    want = docs.union(docs.limit(30))
    got = store.read().drop("_shard")
    assert got.exceptAll(want).count() == 0 and got.count() == 230
    assert store.read(1).count() == 200 and store.vacuum() > 0 and store.read().count() == 230 and store.versions() == [last.version]
    assert sum(s["rows"] for s in last.shards) == 230
    with pytest.raises(sharding.Conflict):
        store.commit(last)
    with pytest.raises(ValueError, match="schema"):
        store.append(docs.select("doc_id"))
    with pytest.raises(ValueError, match="columns"):
        store.append(docs.withColumn("_shard", docs["text"]))
    assert store.compact().version == last.version


def test_sharding_odd_rows(spark, folder):
    store = sharding.Store(spark, folder)
    store.append(odd.frame(spark))
    store.append(odd.frame(spark))
    store.compact()
    assert store.read().count() == 2 * len(odd.rows())


def test_plan_of_tiers():
    shards = [{"name": str(k), "bytes": 10} for k in range(9)] + [{"name": "x", "bytes": 900}, {"name": "y", "bytes": 90}]
    groups = sharding.plan(shards, 40, 4, 10)
    assert [len(g) for g in groups] == [4, 4] and sharding.plan(shards[:3], 1000, 4, 10) == []


def test_plan_over_half_the_target():
    for size in (32, 33, 40, 47):
        groups = sharding.plan([{"name": str(k), "bytes": size << 20} for k in range(20)], 64 << 20, 4, 8 << 20)
        assert [len(g) for g in groups] == [2] * 10, size
    assert sharding.plan([{"name": str(k), "bytes": 48 << 20} for k in range(20)], 64 << 20, 4, 8 << 20) == []


def test_append_cuts_large_pieces(spark, folder):
    store = sharding.Store(spark, folder, target=200_000, fan=3, small=20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = docs.limit(1).withColumn("text", F.lit("".join(map(str, range(40_000)))))
    first = store.append(docs.union(wide).coalesce(1), 20_000)
    over = [s["name"] for s in first.shards if s["bytes"] > 20_000]
    assert len(first.shards) > 12 and all(spark.read.parquet(n).count() == 1 for n in over)
    assert store.read().drop("_shard").exceptAll(docs.union(wide)).count() == 0 and store.read().count() == 201


def test_sharding_query(spark, monkeypatch):
    monkeypatch.setattr(queries, "SHARD_TARGET", 200_000)
    monkeypatch.setattr(queries, "SHARD_SMALL", 25_000)
    data = "/root/testdata/sf0.01"
    docs, stores = spark.read.parquet(f"{data}/documents.parquet"), []
    monkeypatch.setattr(sharding.Store, "vacuum", lambda self: stores.append(self))
    rows = queries.op5_sharding(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    store = stores[0]
    assert store.versions()[-1] > 4 and sum(s["rows"] for s in store.manifest().shards) == len(rows)
    assert all(s["bytes"] <= 25_000 for s in store.manifest(1).shards)
    near = [s["bytes"] for s in store.manifest().shards if s["bytes"] >= 150_000]
    rest = [s for s in store.manifest().shards if s["bytes"] < 150_000]  # fewer than the fan in each tier
    assert len(near) >= 4 and max(near) <= 300_000 and len(rest) < 8 and sharding.plan(rest, 200_000, 4, 25_000) == []


def test_sharding_empty_store(spark, folder):
    store = sharding.Store(spark, folder)
    assert store.read().collect() == [] and store.read().columns == ["_shard"] and store.vacuum() == 0 and store.compact().version == 0


def test_sharding_writers_at_once(spark, folder):
    """Writers, a merge and a vacuum at the same time: each commits, and no row is lost."""
    from concurrent.futures import ThreadPoolExecutor

    store = sharding.Store(spark, folder, target=200_000, fan=3, small=20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    parts = [docs.where(F.col("doc_id") % 4 == k) for k in range(4)]
    store.append(parts[0].repartition(6))

    def merge() -> None:
        try:
            store.compact()
        except sharding.Conflict:
            pass

    with ThreadPoolExecutor(6) as pool:
        jobs = [pool.submit(store.append, p.repartition(3)) for p in parts[1:]] + [pool.submit(merge), pool.submit(store.vacuum, 100)]
        for j in jobs:
            j.result()
    store.vacuum()
    assert store.read().drop("_shard").exceptAll(docs).count() == 0 and store.read().count() == docs.count()
    names = [s["name"] for s in store.manifest().shards]
    assert len(names) == len(set(names)) and len(store.versions()) == 1


def test_sharding_commits_one(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    store = sharding.Store(spark, folder)

    def one(k: int) -> bool:
        try:
            store.commit(sharding.Manifest(1, None, [{"name": str(k), "bytes": 0, "rows": 0}]))
        except sharding.Conflict:
            return False
        return True

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(one, range(8)))
    assert sum(won) == 1 and store.manifest().shards[0]["name"] == str(won.index(True)) and store.versions() == [1]


def test_place_by_rename(spark, folder, monkeypatch):
    """The way of file systems that rename in one step, tried on local files."""
    store = sharding.Store(spark, folder)
    fs, p = common.file_system(spark, folder)
    fs.mkdirs(p)

    class Other:
        def __getattr__(self, name):
            return getattr(fs, name)

        def getUri(self):  # noqa: N802
            return type("Uri", (), {"getScheme": lambda self: "hdfs"})()

    final = store._path("x.json")
    store._place(Other(), store._path("_a"), final, bytearray(b"one"))
    with pytest.raises(sharding.Conflict):
        store._place(Other(), store._path("_b"), final, bytearray(b"two"))
    assert spark.read.text(f"{folder}/x.json").first()[0] == "one"


def test_vacuum_between_write_and_commit(spark, folder, monkeypatch):
    store = sharding.Store(spark, folder)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    commit, seen = sharding.Store.commit, []

    def vacuum_first(self, after):
        if not seen:
            seen.append(sharding.Store(spark, folder).vacuum())
        commit(self, after)

    monkeypatch.setattr(sharding.Store, "commit", vacuum_first)
    store.append(docs)
    assert seen == [0] and store.read().count() == docs.count()
    monkeypatch.setattr(sharding.Store, "commit", lambda self, after: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        store.append(docs)
    assert store.vacuum() > 0 and store.read().count() == docs.count()
    fs, p = common.file_system(spark, f"{folder}/intents/dead")
    fs.create(p, False).close()
    docs.write.parquet(f"{folder}/shards/dead/x")
    assert store.vacuum() == 0 and store.vacuum(lease=-1.0) > 0 and store.read().count() == docs.count()


def test_sharding_query_as_sql(spark):
    import oracle

    oracle.compare(queries.op5_sharding(spark, oracle.DATA), queries.oracle_sql()["op5_sharding"])
