"""Shards of a table under size-tiered compaction.

A store is a folder of immutable shards (one Parquet file each) and numbered manifests.
``append`` writes an arrival as shards of bounded size; ``compact`` merges runs of at least
``fan`` shards of one size tier into files of about ``target`` bytes, tier by
tier, until no run is left; each step commits a new manifest: a complete file gets a name
that must not exist yet, by an operation that the file system does at once (``_place``), so that a
reader sees the old version or the new one and of two writers one fails. ``append`` then commits again
on top of the other's version, and so does ``compact`` if the shards that it merged are still there.

A writer first leaves an intent, then writes its shards in a folder of the same name, commits,
and takes the intent away. ``vacuum`` removes files that no manifest from ``keep`` versions back
names, but not those in a folder with an intent younger than ``LEASE``, so writers that run meanwhile lose nothing.

Merging needs no shuffle: a group of shards, which by its choice is at most one
and a half times the target, is one task that reads its files and writes one. The driver holds file
names and sizes only. A task made again writes the same shard; Spark's committer
keeps one of its attempts.

Arrivals may be empty (a shard without rows), have null or repeated rows and
any columns; rows are kept as they are. A store without a version has no rows and no
columns but _shard. A schema that differs from the store's is
refused. Columns named _shard, _group or _tier are the store's own and refused as well.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import unquote, urlsplit
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, file_system

TARGET, FAN, SMALL = 64 << 20, 4, 8 << 20
#: Groups merged by one job.
WAVE = 64
#: Seconds after which a writer that hasn't committed counts as dead.
LEASE = 24 * 3600.0
#: Commits that a writer tries before it gives up to others.
TRIES = 50
#: Fixed names of stores in which renaming copies, but a file can be created on condition that it doesn't exist.
CONDITIONAL = ("s3a", "s3", "gs")


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class Manifest:
    version: int = 0
    schema: str | None = None
    shards: list[dict] = field(default_factory=list)  # name, bytes, rows

    def text(self) -> str:
        return json.dumps({"version": self.version, "schema": self.schema, "shards": self.shards})


def tier(size: int, small: int, fan: int) -> int:
    """0 for up to ``small`` bytes; one more for each factor of ``fan``."""
    k = 0
    while size > small:
        size, k = size // fan, k + 1
    return k


def plan(shards: list[dict], target: int, fan: int, small: int) -> list[list[dict]]:
    """Groups to merge now: in the lowest tier with ``fan`` shards or more, runs in order of size, of at most
    ``target`` bytes each, or of one and a half times that where less would leave a run under three quarters of
    the target. Shards of three quarters of the target are done."""
    open_ = [s for s in shards if s["bytes"] < target * 3 // 4]
    for k in sorted({tier(s["bytes"], small, fan) for s in open_}):
        of = sorted((s for s in open_ if tier(s["bytes"], small, fan) == k), key=lambda s: (s["bytes"], s["name"]))
        if len(of) < fan:
            continue
        groups: list[list[dict]] = [[]]
        for s in of:
            size = sum(x["bytes"] for x in groups[-1])
            if size + s["bytes"] > target and size >= target * 3 // 4:
                groups.append([])
            groups[-1].append(s)
        groups = [g for g in groups if len(g) >= 2]
        if groups:
            return groups
    return []


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fan: int = FAN, small: int = SMALL):
        self.spark, self.path, self.target, self.fan, self.small = spark, path.rstrip("/"), target, fan, small

    def _list(self, path: str) -> list[tuple[str, int]]:
        fs, p = file_system(self.spark, path)
        return [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n.rpartition("/")[2][:-5]) for n, _ in self._list(f"{self.path}/manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if version is None and not known:
            return Manifest()
        name = f"{self.path}/manifests/{version or known[-1]:012d}.json"
        return Manifest(**json.loads("\n".join(r["value"] for r in self.spark.read.text(name, wholetext=True).collect())))

    def commit(self, after: Manifest) -> None:
        """Writes the manifest under a name of its own, then gives it that of its version; fails if that exists."""
        fs, _ = file_system(self.spark, self.path)
        fs.mkdirs(self._path("manifests"))
        temp, final = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{after.version:012d}.json")
        raw = bytearray(after.text().encode())
        try:
            self._place(fs, temp, final, raw)
        finally:
            fs.delete(temp, False)

    def _place(self, fs, temp, final, raw: bytearray) -> None:
        """All of ``final`` at once or, if it exists, nothing: a link on a local or mounted file system, a conditional
        put in an object store, a rename that doesn't overwrite elsewhere (HDFS does it in one step)."""
        scheme, taken = fs.getUri().getScheme(), f"{final} exists"
        if scheme in CONDITIONAL:
            try:
                out = fs.createFile(final).must("fs.option.create.conditional.overwrite", True).build()
                out.write(raw)
                out.close()
            except Py4JJavaError as e:
                raise Conflict(taken) from e
            return
        out = fs.create(temp, False)
        out.write(raw)
        out.close()
        if scheme == "file":
            try:
                os.link(*(unquote(urlsplit(p.toUri().toString()).path) for p in (temp, final)))
            except FileExistsError as e:
                raise Conflict(taken) from e
            return
        jvm = self.spark.sparkContext._jvm
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, final, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(taken) from e

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _intend(self) -> str:
        """A writer's name, under which its intent and its shards lie."""
        writer = uuid.uuid4().hex
        fs, _ = file_system(self.spark, self.path)
        fs.create(self._path(f"intents/{writer}"), False).close()
        return writer

    def _done(self, writer: str) -> None:
        delete(self.spark, f"{self.path}/intents/{writer}")

    def _written(self, df: DataFrame, writer: str, rows: int = 0) -> list[dict]:
        """Writes one file for each task with rows, or for each ``rows`` rows of it, in a folder of the writer's."""
        folder = f"{self.path}/shards/{writer}/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(folder)
        found = [(n, size) for n, size in self._list(folder) if n.endswith(".parquet")]
        if not found:
            return []
        counts = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()  # from the files' footers
        n = {unquote(r["f"]).rpartition("/")[2]: r["n"] for r in counts}
        return [{"name": name, "bytes": size, "rows": n.get(name.rpartition("/")[2], 0)} for name, size in found]

    def _merged(self, groups: list[list[dict]], schema: str, writer: str) -> list[dict]:
        """Writes a file for each group, as a union of single partitions. Spark must not lay them into one: that is
        set in a session of its own, not in the caller's."""
        own = self.spark.newSession()
        own.conf.set("spark.sql.unionOutputPartitioning", "false")
        merged = None
        for g in groups:
            one = self._read([s["name"] for s in g], schema, own).coalesce(1)
            merged = one if merged is None else merged.union(one)
        return self._written(merged, writer)

    def _cut(self, shards: list[dict], most: int, schema: str, writer: str) -> list[dict]:
        """Shards over ``most`` bytes are written again with fewer rows to a file, until only single rows are over it."""
        done = [s for s in shards if s["bytes"] <= most]
        large = [s for s in shards if s["bytes"] > most]
        while large:
            by: dict[int, list[str]] = {}  # by rows to a file, as a power of two: dense and sparse shards apart
            for s in large:
                if s["rows"] < 2:
                    done.append(s)
                else:
                    by.setdefault(1 << max(1, s["rows"] * most * 3 // 4 // s["bytes"]).bit_length() - 1, []).append(s["name"])
            large = []
            for n, names in by.items():
                new = self._written(self._read(names, schema), writer, n)
                done += [s for s in new if s["bytes"] <= most]
                large += [s for s in new if s["bytes"] > most]
                for name in names:
                    delete(self.spark, name)
        return done

    def append(self, arrival: DataFrame, most: int | None = None) -> Manifest:
        """Commits the rows of ``arrival`` as shards, one for each of its partitions; partitions of over ``most``
        bytes (the target, if not given) are cut into more."""
        if clash := {"_shard", "_group", "_tier"} & set(arrival.columns):
            raise ValueError(f"columns of the store: {sorted(clash)}")
        schema = arrival.schema.json()
        self._same(self.manifest(), schema)
        writer = self._intend()
        try:
            new = self._cut(self._written(arrival, writer), most or self.target, schema, writer)
            return self._committed(lambda now: (self._same(now, schema), Manifest(now.version + 1, schema, now.shards + new))[1])
        finally:
            self._done(writer)

    def _same(self, now: Manifest, schema: str) -> None:
        if now.schema not in (None, schema):
            raise ValueError("the schema differs from the store's")

    def _committed(self, after) -> Manifest:
        """Commits what ``after`` makes of the newest version; again if another writer was first."""
        for _ in range(TRIES):
            made = after(self.manifest())
            try:
                self.commit(made)
            except Conflict:
                continue
            return made
        raise Conflict(f"others were first {TRIES} times")

    def compact(self) -> Manifest:
        """Merges until no run is left; a version for each round."""
        now = self.manifest()
        while groups := plan(now.shards, self.target, self.fan, self.small):
            writer = self._intend()
            try:
                new = [s for k in range(0, len(groups), WAVE) for s in self._merged(groups[k : k + WAVE], now.schema, writer)]
                gone = {s["name"] for g in groups for s in g}

                def after(last: Manifest, gone=gone, new=new) -> Manifest:
                    if not gone <= {s["name"] for s in last.shards}:
                        raise Conflict("another writer merged the same shards")
                    return Manifest(last.version + 1, last.schema, [s for s in last.shards if s["name"] not in gone] + new)

                now = self._committed(after)
            finally:
                self._done(writer)
        return now

    def vacuum(self, keep: int = 1, lease: float = LEASE) -> int:
        """Removes shards that none of the last ``keep`` manifests names, and older manifests.

        Folders are listed before intents and these before manifests: a folder without an intent
        was committed, or given up, before its manifest is looked for."""
        writers = [n for n, _ in self._list(f"{self.path}/shards")]
        intents = self._running(lease)
        known = self.versions()
        live = {s["name"] for v in known[-keep:] for s in self.manifest(v).shards}
        gone = 0
        for writer in writers:
            if writer.rpartition("/")[2] in intents:
                continue
            files = [n for folder, _ in self._list(writer) for n, _ in self._list(folder) if n.endswith(".parquet")]
            dead = [n for n in files if n not in live]
            for n in [writer] if len(dead) == len(files) else dead:
                delete(self.spark, n)
            gone += len(dead)
        for v in known[:-keep]:
            delete(self.spark, f"{self.path}/manifests/{v:012d}.json")
        return gone

    def _running(self, lease: float) -> set[str]:
        """Writers with an intent; older ones than the lease lose theirs."""
        fs, p = file_system(self.spark, f"{self.path}/intents")
        out = set()
        for status in fs.listStatus(p) if fs.exists(p) else []:
            if time.time() - status.getModificationTime() / 1000 < lease:
                out.add(status.getPath().getName())
            else:
                fs.delete(status.getPath(), False)
        return out

    def _read(self, names: list[str], schema: str | None, spark: SparkSession | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        spark = spark or self.spark
        kind = StructType.fromJson(json.loads(schema)) if schema else StructType()
        return spark.read.schema(kind).parquet(*names) if names else spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the name of their shard (_shard)."""
        m = self.manifest(version)
        return self._read([s["name"] for s in m.shards], m.schema).withColumn("_shard", F.input_file_name())
