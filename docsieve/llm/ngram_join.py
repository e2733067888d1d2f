"""Exact n-gram Jaccard self-join of documents on sets of 5-word shingles.

Method: the shingles of a set are hashed into groups; the counts by group are a
point, and an R-tree over such points bounds the overlap of two sets by the sum
of the smaller coordinates (``CountTree``). What passes the bound is verified on
the sets themselves.

On a cluster the sets meet as follows.

1. Equal sets are one class (map-side combine), so a text copied a million
   times is one point.
2. Shingles are ordered by an estimate of their frequency (a sketch of fixed
   size over all documents), rare ones first. Two sets with similarity of 0.8
   or more share one of their first n - ceil(0.8 n) + 1 shingles, so sharing
   one of these is necessary. The classes at a shingle are a group, and groups
   of one smallest class (their leader) are one. A frequent line or passage comes
   last in the order and makes no group. An R-tree over all classes would have to
   be on every executor; there is one for each group instead.
3. Each group's tree is asked for the points that its leader's point may be similar to,
   and these are verified. Groups whose members are in one component by then are
   done: no pair in them can add anything. That is where large groups of near
   copies end, in time linear in their size.
4. What is left of a group are members outside of its leader's component. Trees
   over them, and over them and those inside, name the pairs of different components within the
   bound; these are verified on bits, and a link is returned if it joins
   components. Blocks bound a tree's size: members inside are dealt to one block
   each and meet the blocks of those outside only. No candidate pair is left out,
   and what is returned grows with the members, not with their pairs.

A group that is hot (its leader has more than one in 4096 of all rows) is dealt
over parts before it is joined with anything.

Nulls and empty texts have no shingles, class or link; each is its own
component. Rows with one doc_id are handled as rows of their own, each in the
component of its text. A null doc_id can't name a component; if all members have none, it
is null. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, hot_keys, join_checked, ready, split_join, text_buffer, with_parts
from .components import connected
from .kernels import shingle_sets

GROUPS = 128
SLOTS = 1 << 16
#: Shingles in a block of a group, on average: bounds a task's memory, whether sets are many or large.
BLOCK = 400_000
#: Members of a group beyond which it is dealt over up to MOST blocks, however small its sets are, so that no task has it all.
MEMBERS, MOST = 500, 8
#: Members in one tree that a leader asks.
TREE = 4096
#: Bytes of bits; beyond it, sets are intersected one pair at a time.
BITS = 1 << 26


def _bits(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def class_id(s: np.ndarray) -> int:
    """64 bits that depend on the set only."""
    x = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    total = int(x.sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15)
    total &= (1 << 64) - 1
    total = ((total ^ (total >> 31)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return total - (1 << 64) if total >> 63 else total


def counts_of(s: np.ndarray) -> bytes:
    """Counts by group: GROUPS of them, doubled while a group would hold over 4 shingles on average."""
    bits = GROUPS.bit_length() - 1
    while len(s) > 4 << bits:
        bits += 1
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u4").tobytes()


def same_groups(points: list[bytes]) -> np.ndarray:
    """Points at the coarsest resolution among them: neighbouring groups are summed."""
    n = min(map(len, points))
    if n == max(map(len, points)):
        return np.frombuffer(b"".join(points), "<u4").reshape(len(points), -1).astype(np.int64)
    return np.stack([np.frombuffer(p, "<u4").astype(np.int64).reshape(n // 4, -1).sum(1) for p in points])


def slots_of(s: np.ndarray) -> np.ndarray:
    return ((s >> np.uint64(20)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; at the end, one with this task's counts by slot."""
    names = ["doc_id", "row_key", "n_shingles", "cid", "counts", "sketch"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    sketch = np.zeros(SLOTS, np.int64)
    for b in batches:
        raw, at = text_buffer(b.column("text"))
        n, cid, counts = [], [], []
        for s in shingle_sets(raw, at):
            n.append(len(s))
            cid.append(class_id(s) if len(s) else None)
            counts.append(counts_of(s) if len(s) else None)
            np.add.at(sketch, slots_of(s), 1)
        cols = [b.column("doc_id").cast(pa.int64()), b.column("row_key"), n, cid, counts, [None] * len(n)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, None, None, None, sketch], types, strict=True)], names=names)


def prefix_of(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rarest n - ceil(0.8 n) + 1 shingles, by the same order for all sets."""
    n = len(s)
    k = n - (4 * n + 4) // 5 + 1
    r = rank[slots_of(s)]
    return s[np.lexsort((s, r))[:k]]


def _prefixes(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            raw, at = text_buffer(b.column("text"))
            sig, cid = [], []
            for s in shingle_sets(raw, at):
                if not len(s) or (c := class_id(s)) in seen:
                    continue
                seen.add(c)  # saves work only: the same rows again would change nothing
                sig.append(p := prefix_of(s, rank))
                cid.append(np.full(len(p), c, np.int64))
            if len(seen) > 200_000:
                seen.clear()
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(_bits(np.concatenate(sig))), pa.array(np.concatenate(cid))], names=["sig", "cid"])

    return run


def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap at which 100 * intersection >= 80 * union."""
    return (4 * (n + m) + 8) // 9


def is_similar(x: np.ndarray, y: np.ndarray) -> bool:
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


class CountTree:
    """R-tree, bulk-loaded: leaves of 16 points, nodes of 16 children.

    A node keeps the largest coordinates and the range of set sizes and of
    component labels under it; two nodes can hold a link only if the sum of
    the smaller coordinates reaches what their smallest sets need, and if not
    all under them is one component."""

    FAN = 16

    def __init__(self, points: np.ndarray, comp: np.ndarray):
        size = points.sum(1)
        # by size, then in slabs by where the most weight is: near points stay together
        top = np.argsort(-points[:, : min(16, points.shape[1])], axis=1, kind="stable")[:, 0]
        self.order = np.lexsort((comp, top, size))
        self.points, self.comp, self.size = points[self.order], comp[self.order], size[self.order]
        self.levels = [(self.points, self.size, self.size, self.comp, self.comp)]
        while len(self.levels[-1][0]) > 1:
            hi, s0, s1, c0, c1 = self.levels[-1]
            cut = np.arange(0, len(hi), self.FAN)
            self.levels.append((np.maximum.reduceat(hi, cut), np.minimum.reduceat(s0, cut), np.maximum.reduceat(s1, cut), np.minimum.reduceat(c0, cut), np.maximum.reduceat(c1, cut)))

    def near(self, point: np.ndarray) -> np.ndarray:
        """Indices of the points that pass the bound with ``point``, whatever their component."""
        m, at = int(point.sum()), np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            hi, s0, s1, _, _ = self.levels[level]
            at = at[at < len(hi)]
            at = at[(5 * s1[at] >= 4 * m) & (5 * m >= 4 * s0[at])]
            at = at[np.minimum(hi[at], point).sum(1) >= need(s0[at], m)]
            if level:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        return self.order[at]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices of points of different components that pass the bound, each pair once, in pieces."""
        yield from self._walk(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))

    def _walk(self, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hi, s0, s1, c0, c1 = self.levels[level]
        if level == 0:
            keep = i < j
            i, j = i[keep], j[keep]
        i, j = self._passing(level, i, j)
        if level == 0:
            if len(i):
                yield self.order[i], self.order[j]
            return
        n = len(self.levels[level - 1][0])
        for k in range(0, len(i), 256):  # bounds what is in memory
            a, b = i[k : k + 256], j[k : k + 256]
            x = (a[:, None] * self.FAN + np.arange(self.FAN))[:, :, None] + np.zeros(self.FAN, np.int64)
            y = (b[:, None] * self.FAN + np.arange(self.FAN))[:, None, :] + np.zeros((self.FAN, 1), np.int64)
            x, y = x.ravel(), y.ravel()
            ok = (x < n) & (y < n) & (x <= y)
            yield from self._walk(level - 1, x[ok], y[ok])

    def _passing(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hi, s0, s1, c0, c1 = self.levels[level]
        ok = ~((c0[i] == c1[i]) & (c0[j] == c1[j]) & (c0[i] == c0[j]))
        ok &= (5 * s1[i] >= 4 * s0[j]) & (5 * s1[j] >= 4 * s0[i])
        i, j = i[ok], j[ok]
        out = []
        for k in range(0, len(i), 8192):
            a, b = i[k : k + 8192], j[k : k + 8192]
            out.append(np.minimum(hi[a], hi[b]).sum(1) >= need(s0[a], s0[b]))
        ok = np.concatenate(out) if out else np.zeros(0, bool)
        return i[ok], j[ok]


class Sets:
    """Sets of one cell as bits over the shingles that more than one of them has: exact intersections, many at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        _, at, n = np.unique(every, return_inverse=True, return_counts=True)
        column = np.cumsum(n > 1) - 1
        width = int(column[-1] + 1) // 64 + 1
        self.sets, self.bits = sets, None
        if 8 * width * len(sets) <= BITS:
            row = np.repeat(np.arange(len(sets)), self.size)
            shared = n[at] > 1
            row, bit = row[shared], column[at[shared]]
            self.bits = np.zeros((len(sets), width), np.uint64)
            np.bitwise_or.at(self.bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([is_similar(self.sets[x], self.sets[y]) for x, y in zip(i, j, strict=True)], bool)
        out, step = [], max(1, (1 << 22) // self.bits.shape[1])
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            both = np.bitwise_count(self.bits[x] & self.bits[y]).sum(1, dtype=np.int64)
            out.append(100 * both >= 80 * (self.size[x] + self.size[y] - both))
        return np.concatenate(out) if out else np.zeros(0, bool)


class Unions:
    """Union-find over the labels of components."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _leaders_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part of a group, its leader first: the leader with each member that its point may be similar to.

    A tree holds at most TREE members of a part; more of them come in more trees."""
    part, point, cids, points, found = None, b"", [], [], []

    def asked() -> None:
        if cids:
            every = same_groups([point, *points])
            found.extend((part[0], cids[k]) for k in CountTree(every[1:], np.arange(len(cids))).near(every[0]).tolist())
            cids.clear()
            points.clear()

    def out() -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for leader, block, is_member, cid, counts in zip(*(batch.column(k).to_pylist() for k in ("leader", "block", "member", "cid", "counts")), strict=True):
            if not is_member:
                asked()
                part, point = (leader, block), counts
            else:
                cids.append(cid)
                points.append(counts)
                if len(cids) == TREE:
                    asked()
        if found:
            yield out()
    asked()
    yield out()


def _led_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by part of a group, its leader's set first: the leader with each member whose set is similar."""
    part, own, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        a, b = [], []
        for leader, block, cid, shingles in zip(*(batch.column(k).to_pylist() for k in ("leader", "block", "cid", "shingles")), strict=True):
            if cid == leader:
                part, own, last = (leader, block), np.frombuffer(shingles, np.uint64), cid
            elif cid != last:  # a class whose row comes more than once may be sent by several tasks
                assert part == (leader, block)
                last = cid
                if is_similar(own, np.frombuffer(shingles, np.uint64)):
                    a.append(leader)
                    b.append(cid)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _cell_links(rows: list[tuple]) -> Iterator[tuple[int | None, int | None, int]]:
    """Of one block pair of one group: links enough to join what its links join, and last how many pairs were verified."""
    cid, block = [r[4] for r in rows], np.array([r[7] for r in rows], np.int64)
    _, comp = np.unique(np.array([r[5] for r in rows], np.int64), return_inverse=True)
    if comp.max() == 0:
        return
    sets = [np.frombuffer(r[6], np.uint64) for r in rows]
    across, exact, joined, checked = rows[0][2] != rows[0][3], Sets(sets), Unions(), 0
    for i, j in CountTree(same_groups([counts_of(s) for s in sets]), comp).pairs():
        ok = (comp[i] != comp[j]) & ((block[i] != block[j]) | (not across))
        i, j = i[ok], j[ok]
        ok = exact.similar(i, j)
        checked += len(i)
        for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if joined.join(int(comp[x]), int(comp[y])):
                yield cid[x], cid[y], 0
    yield None, None, checked


_CELL = ["leader", "band", "i", "j"]


def _promising(rows: list[tuple]) -> Iterator[tuple]:
    """Of one block pair of one group: the members that have a partner within the bound."""
    _, comp = np.unique(np.array([r[5] for r in rows], np.int64), return_inverse=True)
    if comp.max() == 0:
        return
    block = np.array([r[7] for r in rows], np.int64)
    across, hit = rows[0][2] != rows[0][3], np.zeros(len(rows), bool)
    for i, j in CountTree(same_groups([r[6] for r in rows]), comp).pairs():
        ok = (comp[i] != comp[j]) & ((block[i] != block[j]) | (not across))
        hit[i[ok]] = hit[j[ok]] = True
    for k in np.flatnonzero(hit):
        r = rows[k]
        yield (*r[:6], r[7])


def _by_cell(work, data: str, names: list[str], types: list[pa.DataType]):
    """Runs ``work`` on the rows of each block pair of each group; rows come sorted by these."""

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found := list(work(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in (*_CELL, "cid", "comp", data, "block")), strict=True):
                if rows and rows[0][:4] != r[:4]:
                    yield from emit(rows)
                    rows = []
                if not rows or rows[-1][4] != r[4]:  # a class whose row comes more than once may be sent by several tasks
                    rows.append(r)
        if rows:
            yield from emit(rows)

    return run


def _cells(df: DataFrame) -> DataFrame:
    return df.repartition(*_CELL).sortWithinPartitions(*_CELL, "cid")


def row_key():
    """64 bits of a row's doc_id and text: finds the texts of a class again, also where doc_id is null or repeated."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, class_id."""
    return joined(docs).select("doc_id", "n_shingles", "component_id", "class_id")


def joined(docs: DataFrame, report: dict[str, int] | None = None) -> DataFrame:
    """The same with row_key and comp, the component's smallest class, which also tells components of one id apart.

    ``report``, if given, is filled with counts: candidates (members asked by their leader), bounded
    (of these, what the trees let through), verified (pairs compared exactly) and linked."""
    spark = docs.sparkSession
    ready(spark)
    out = Scratch(spark, "ngram")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text")
    described = out.table(texts.mapInArrow(_described, "doc_id long, row_key long, n_shingles long, cid long, counts binary, sketch array<long>"), "described")
    rows = described.where("sketch is null").drop("sketch")
    slots = described.where("sketch is not null").select(F.posexplode("sketch").alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n")).where("n > 0").collect()
    rank = np.zeros(SLOTS, np.int64)  # SLOTS numbers, however large the corpus is
    for slot, n in slots:
        rank[slot] = n
    classes = out.table(rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("counts").alias("counts"), F.min("row_key").alias("row_key")), "classes")
    sizes, points = classes.select("cid", "n"), classes.select("cid", "counts")

    prefixes = out.table(texts.select("text").mapInArrow(_prefixes(rank), "sig long, cid long"), "prefixes")
    leaders = prefixes.groupBy("sig").agg(F.min("cid").alias("leader"), F.max("cid").alias("last"), F.count("*").alias("n")).where("leader < last").select("sig", "leader", "n")
    leaders = out.table(leaders, "leaders")
    out.free()
    star = split_join(prefixes, leaders.select("sig", "leader"), ["sig"], hot_keys(leaders.select("sig", "n"), "sig"), "cid")
    star = out.table(star.where("cid != leader").select("leader", "cid").distinct().join(sizes, "cid"), "members")
    hot = hot_keys(star.groupBy("leader").agg(F.count("*").alias("n")), "leader")
    star = out.table(split_join(star, sizes.toDF("leader", "leader_n"), ["leader"], hot, "cid"), "star")
    out.drop("prefixes", "members")
    out.free()

    near_size = star.where("5 * n >= 4 * leader_n and 5 * leader_n >= 4 * n").select("leader", "cid")  # before the points are sent
    asked = _by_leader(_led(near_size).join(points, "cid"), hot)
    bounded = out.table(asked.mapInArrow(_leaders_near, "a long, b long"), "bounded")
    # one leader each first: mostly that joins what the others would join, and no set is sent in vain
    first = bounded.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    near = _verified(out, texts, classes, out.table(first, "one"), hot, "near-one")
    comp = connected(out, near, "first")
    apart = _apart(bounded.join(first, ["a", "b"], "left_anti"), comp)
    apart = out.table(apart, "others")
    if apart.take(1):
        others = _verified(out, texts, classes, apart, hot, "near-others")
        comp = connected(out, _known(comp).unionByName(others), "second")
        near = near.unionByName(others)
    if report is not None:
        report |= {"candidates": near_size.count(), "bounded": bounded.count(), "verified": out.read("one").count() + apart.count(), "linked": near.count()}

    # a group's members by size: sets that can be similar are in the same band or in neighbouring ones
    members = star.select("leader", "cid", "n").unionByName(star.select("leader", F.col("leader").alias("cid"), F.col("leader_n").alias("n")).distinct())
    labels = comp.toDF("cid", "comp")
    leading = star.select("leader").distinct().join(comp.toDF("leader", "comp"), "leader", "left").select("leader", F.coalesce("comp", "leader").alias("leader_comp"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.26)).cast("int")
    labelled = members.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    labelled = split_join(labelled, leading, ["leader"], hot, "cid").select("leader", "cid", "n", "comp", (F.col("comp") == F.col("leader_comp")).alias("inside"), F.explode(F.array(band, band + 1)).alias("band"))
    labelled = out.table(labelled, "labelled")
    mixed = labelled.groupBy("leader", "band").agg(
        F.count("*").alias("size"), F.count(F.when(F.col("inside"), 1)).alias("m_in"), F.count(F.when(~F.col("inside"), 1)).alias("m_out"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("n_in"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("n_out"),
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max(F.col("cid") == F.col("leader")).alias("led"),
    )
    mixed = mixed.where("c0 != c1 and (size > 2 or not led)")
    blocks = {k: F.when(F.col(f"m_{k}") > 0, F.greatest((F.col(f"n_{k}") / BLOCK).cast("int"), F.least((F.col(f"m_{k}") / MEMBERS).cast("int"), F.lit(MOST - 1))) + 1).otherwise(0) for k in ("in", "out")}
    mixed = mixed.select("leader", "band", *(b.alias(f"b_{k}") for k, b in blocks.items()))
    # blocks 0 to b_in - 1 are of members inside, the others of those outside; each block outside meets all
    spread = split_join(labelled, mixed, ["leader", "band"], hot, "cid").join(points, "cid")
    spread = spread.withColumn("block", F.when(F.col("inside"), F.pmod(F.xxhash64("cid"), F.greatest("b_in", F.lit(1)))).otherwise(F.col("b_in") + F.pmod(F.xxhash64("cid"), F.greatest("b_out", F.lit(1)))).cast("int"))
    met = F.when(F.col("inside"), F.sequence("b_in", F.col("b_in") + F.col("b_out") - 1)).otherwise(F.sequence(F.lit(0), F.col("b_in") + F.col("b_out") - 1))
    spread = spread.withColumn("other", F.explode(met)).select("leader", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "comp", "counts", "block")
    kept = [*_CELL, "cid", "comp", "block"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    cells = _cells(spread).mapInArrow(_by_cell(_promising, "counts", kept, types), "leader long, band int, i int, j int, cid long, comp long, block int")
    cells = out.table(cells, "cells")
    out.free()
    if cells.take(1):
        full = _sent(out, texts, classes, cells, "cells")
        more = out.table(_cells(full).mapInArrow(_by_cell(_cell_links, "shingles", ["a", "b", "verified"], [pa.int64()] * 3), "a long, b long, verified long"), "more")
        out.drop("cells-ids")
        out.free()
        links = more.where("a is not null").select("a", "b")
        if report is not None:
            pairs = more.agg(F.sum("verified")).first()[0] or 0
            report |= {"bounded": report["bounded"] + pairs, "verified": report["verified"] + pairs, "linked": report["linked"] + links.count()}
        if links.take(1):
            comp = connected(out, _known(comp).unionByName(links), "last")
    named = (
        classes.select("cid", "rep").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
        .select("cid", "rep", F.coalesce("comp", "cid").alias("comp"))
    )
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    final = split_join(named.select("comp", "cid"), names.drop("n"), ["comp"], hot_keys(names.select("comp", "n"), "comp"), "cid").select("cid", "comp", "component_id")
    copies = hot_keys(rows.where("cid is not null").groupBy("cid").agg(F.count("*").alias("n")), "cid")
    found = split_join(rows.select("cid", "row_key", "doc_id", "n_shingles"), final, ["cid"], copies, "row_key", "left")
    return found.select(
        "row_key", "comp", "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("cid").alias("class_id")
    )


def _known(comp: DataFrame) -> DataFrame:
    """Links that say the same as components: each node with the smallest."""
    return comp.where("node != comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of classes (a, b), a a leader, that aren't in one component yet."""
    for side in ("a", "b"):
        pairs = pairs.join(comp.toDF(side, f"comp_{side}"), side, "left").withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", side))
    return pairs.where("comp_a != comp_b").select("a", "b")


def _led(members: DataFrame) -> DataFrame:
    """Members of groups (leader, cid), and each leader as the one of its group whose cid is the leader."""
    return members.select("leader", "cid").union(members.select("leader", F.col("leader").alias("cid")).distinct())


def _by_leader(led: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows of ``_led`` by part (leader, block) of a group, the leader first: one part, or those of a hot leader, each with its row."""
    own, part = F.col("cid") == F.col("leader"), F.pmod(F.xxhash64("cid"), F.col("_parts")).cast("int")
    dealt = with_parts(led, "leader", hot).withColumn("block", F.explode(F.when(own, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(part)))).drop("_parts")
    return dealt.withColumn("member", ~own).repartition("leader", "block").sortWithinPartitions("leader", "block", "member", "cid")


def _sent(out: Scratch, texts: DataFrame, classes: DataFrame, routes: DataFrame, name: str) -> DataFrame:
    """``routes`` (cid and other columns) with the class's set, made again from the rows of one key of it.

    What a class's set is for travels with its text, so a set is shuffled only to where it is compared."""
    fields = [c for c in routes.columns if c != "cid"]
    listed = routes.groupBy("cid").agg(F.collect_list(F.struct(*fields)).alias("routes"))
    ids = out.table(classes.select("cid", "row_key").join(listed, "cid"), f"{name}-ids")
    small = (ids.agg(F.sum(F.size("routes"))).first()[0] or 0) <= BROADCAST_ROWS // len(fields)
    found = texts.select("row_key", "text").join(F.broadcast(ids) if small else ids.hint("merge"), "row_key").select("cid", "text", "routes")
    sets = found.mapInArrow(_sets_checked, f"cid long, shingles binary, routes {dict(ids.dtypes)['routes']}")
    return sets.select("cid", "shingles", F.explode("routes").alias("route")).select("cid", "shingles", "route.*")


def _verified(out: Scratch, texts: DataFrame, classes: DataFrame, pairs: DataFrame, hot: DataFrame | None, name: str) -> DataFrame:
    """Of pairs of classes (a, b), a a leader, those whose sets are similar."""
    sets = _sent(out, texts, classes, _led(pairs.toDF("leader", "cid")), name)
    found = out.table(_by_leader(sets, hot).mapInArrow(_led_links, "a long, b long"), name)
    out.drop(f"{name}-ids")
    out.free()
    return found


def _sets_checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        b = b.filter(pa.array([c not in seen for c in b.column("cid").to_pylist()], pa.bool_()))  # a copied row once a task
        raw, at = text_buffer(b.column("text"))
        cids, sets, kept = [], [], []
        for k, (want, s) in enumerate(zip(b.column("cid").to_pylist(), shingle_sets(raw, at), strict=True)):
            if len(s) and want not in seen and class_id(s) == want:
                seen.add(want)
                cids.append(want)
                sets.append(s.tobytes())
                kept.append(k)
        routes = b.column("routes").take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.binary()), routes], names=["cid", "shingles", "routes"])
        if len(seen) > 200_000:
            seen.clear()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Rows without words stay, as do rows with a null doc_id (nothing names them).
    Rows are told apart by doc_id and text: of rows of one doc_id, those in one component leave one, and
    texts that aren't near copies stay each."""
    key = ["doc_id", "row_key"]
    found = joined(docs).where("doc_id is not null and n_shingles > 0").select(*key, "comp", "component_id")
    found = Scratch(docs.sparkSession, "kept").table(found, "rows")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"))
    out = join_checked(keyed, found.where("doc_id != component_id").select(key).distinct(), key, "left_anti")
    same = found.where("doc_id = component_id").groupBy("comp").agg(F.count("*").alias("n"), F.min("row_key").alias("least")).where("n > 1")
    if not same.take(1):
        return out.select("row.*")
    # of these components the rows with the smallest key stay, once
    twice = found.where("doc_id = component_id").join(same, "comp").groupBy(key).agg(F.max(F.col("row_key") == F.col("least")).alias("stays"))
    once = join_checked(out, twice.where("stays").select(key), key, "left_semi").dropDuplicates(key)
    return join_checked(out, twice.select(key), key, "left_anti").unionByName(once).select("row.*")
