"""Benchmark decontamination by the q-gram lemma.

An item of n characters that occurs in a document with at most k edits shares
n - q + 1 - k q of its q-grams with it, on at most k + 1 neighbouring diagonals
(place in the document minus place in the item). Shared q-grams are counted in
overlapping bands of 2 (k + 1) diagonals, of which one holds all of an
occurrence's; bands that reach the bound are regions, and a banded alignment of
the item with its region gives the edits. A document is contaminated if some
item aligns within its budget of k = ``RATE`` n edits (less for short items, so that
the bound stays positive; items under q characters must occur as they are).

Each place of an item is reported: of all parts of a text within the budget those
with the fewest edits (then the first ones) that don't overlap. A part starts where its
alignment starts; of starts that need as few edits the last one counts.

Texts and items are compared in lower case with runs of white space as one
space; spans count code points of that form. q-grams that are in many items
don't count for an item that has enough others, with its bound lowered
accordingly, so no occurrence is lost.

The items are the stated query set, held against all documents in one scan
without a shuffle. Their index comes in blocks of at most ``BLOCK`` characters, each a
broadcast of its own; where there are more blocks, a task takes ``CHUNK`` bytes of
documents at a time through all of them and holds one block in memory. A null or
empty text is clean. Null and empty items match nothing. Rows are judged one by
one, whatever their doc_id, and dropped or kept where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

Q, RATE, BLOCK = 8, 0.1, 4_000_000
#: Bytes of documents that are held against one block after the other.
CHUNK = 32 << 20
#: q-grams in more places than this don't count for items that have enough others.
COMMON = 8
_BITS = 22
_A, _A2, _A4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(x: np.ndarray) -> np.ndarray:
    """Hashes of all 8-grams."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    h = x.astype(np.uint64)
    h = h[:-1] * _A + h[1:]
    h = h[:-2] * _A2 + h[2:]
    h = h[:-4] * _A4 + h[4:]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        rows = [(i, normal(t)) for i, t in items]
        self.short = [(i, t) for i, t in rows if 0 < len(t) < Q]
        rows = [(i, t) for i, t in rows if len(t) >= Q]
        self.ids, self.texts = [i for i, _ in rows], [t for _, t in rows]
        n = np.array([len(t) for t in self.texts], np.int64)
        self.size = n
        self.edits = np.minimum((RATE * n).astype(np.int64), (n - Q) // Q)
        each = [grams(codes(t)) for t in self.texts]
        every = np.concatenate(each) if each else np.zeros(0, np.uint64)
        unique, at, count = np.unique(every, return_inverse=True, return_counts=True)
        gram, item, place, bound, a = [], [], [], [], 0
        for k, g in enumerate(each):
            ids = at[a : a + len(g)]
            a += len(g)
            keep = np.ones(len(g), bool)
            rare = count[ids] <= COMMON
            if rare.sum() - Q * self.edits[k] >= COMMON:
                keep = rare
            bound.append(keep.sum() - Q * self.edits[k])
            gram.append(ids[keep])
            item.append(np.full(keep.sum(), k))
            place.append(np.flatnonzero(keep))
        self.bound = np.array(bound, np.int64)
        gram = np.concatenate(gram) if gram else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.item = np.concatenate(item)[order] if item else gram
        self.place = np.concatenate(place)[order] if place else gram
        self.first = np.searchsorted(gram[order], np.arange(len(unique) + 1))
        used = np.diff(self.first) > 0
        self.grams = unique
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(unique[used] >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) pairs of which the count reaches the item's bound."""
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return []
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        ok = self.grams[k] == h[at]
        at, k = at[ok], k[ok]
        n = self.first[k + 1] - self.first[k]
        found: dict[tuple[int, int], int] = {}
        keys = []
        for a in range(0, len(at), 65536):  # bounds what is in memory; q-grams in many items come often
            m = n[a : a + 65536]
            into = np.repeat(self.first[k[a : a + 65536]] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            item = self.item[into]
            w = self.edits[item] + 1
            band = (np.repeat(at[a : a + 65536], m) - self.place[into] + self.size[item]) // w
            key = (item << 40) | band
            keys.append(np.stack(np.unique(np.concatenate((key, key[band > 0] - 1)), return_counts=True)))
        if not keys:
            return []
        if len(keys) == 1:
            key, count = keys[0]
        else:
            both = np.concatenate(keys, axis=1)
            key, to = np.unique(both[0], return_inverse=True)
            count = np.bincount(to, weights=both[1]).astype(np.int64)
        item = key >> 40
        ok = count >= self.bound[item]
        found = list(zip(item[ok].tolist(), (key[ok] & ((1 << 40) - 1)).tolist(), strict=True))
        return found

    def occurrences(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of each place of an item."""
        out = [(i, a, a + len(t), 0) for i, t in self.short for a in _places(text, t)]
        ends: dict[int, dict[int, tuple[int, int]]] = {}  # by item and end: edits, -start
        x = codes(text)
        for item, band in self.regions(grams(x)):
            n, k = int(self.size[item]), int(self.edits[item])
            w = k + 1
            low = max(0, band * w - n - k)
            high = min(len(text), (band + 2) * w - n + n + k)
            of = ends.setdefault(item, {})
            exact = text.find(self.texts[item], low, high)
            if exact >= 0:  # all else in the region overlaps it
                of[exact + n] = (0, -exact)
                continue
            for end, edits, start in aligned(codes(self.texts[item]), x[low:high], 2 * w + 2 * k, k):
                of[low + end] = min(of.get(low + end, (k + 1, 0)), (edits, -(low + start)))
        return sorted(out + [(self.ids[i], *v) for i, of in ends.items() for v in apart(of)])


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + len(part))


def apart(ends: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """start, end, edits of those with the fewest edits, the first ones first, that don't overlap."""
    out: list[tuple[int, int, int]] = []
    for edits, end, start in sorted((e, end, -s) for end, (e, s) in ends.items()):
        if all(end <= a or b <= start for a, b, _ in out):
            out.append((start, end, edits))
    return out


#: What an edit costs; below it, costs tell starts apart, the last one being the least.
_EDIT, _FAR = 1 << 32, 1 << 60


def aligned(item: np.ndarray, region: np.ndarray, width: int, most: int) -> list[tuple[int, int, int]]:
    """(end, edits, start) for each end of a part of the region that is within ``most`` edits of the item.

    Only diagonals 0 to ``width`` are looked at; all of an occurrence within the
    budget lie there."""
    n = len(item)
    t = np.concatenate((region.astype(np.int64), np.full(n + width + 2, -1)))
    o = np.arange(width + 1)
    now = np.where(o <= len(region), -o, _FAR)  # any start
    for i in range(n):
        step = now + _EDIT * (t[i : i + width + 1] != item[i])
        step[:-1] = np.minimum(step[:-1], now[1:] + _EDIT)
        step = np.minimum.accumulate(step - o * _EDIT) + o * _EDIT
        now = np.where(i + 1 + o <= len(region), step, _FAR)
    edits = -(-now // _EDIT)
    return [(n + int(k), int(edits[k]), int(edits[k] * _EDIT - now[k])) for k in np.flatnonzero(edits <= most)]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("i"), "text").toLocalIterator():
        if block and size + len(r["text"]) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r["i"], r["text"]))
        size += len(r["text"])
    yield block


def _found(sent: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple]]]]:
    """Each batch with the places in its texts."""
    if len(sent) == 1:
        for b in batches:
            yield b, [sent[0].value.occurrences(normal(t)) for t in b.column("text").to_pylist()]
        return
    held, size = [], 0
    for b in chain(batches, [None]):
        if b is not None:
            held.append(b)
            size += b.nbytes
        if held and (b is None or size >= CHUNK):
            texts = [[normal(t) for t in h.column("text").to_pylist()] for h in held]
            found = [[[] for _ in t] for t in texts]
            for block in sent:
                index = block.value
                for t, f in zip(texts, found, strict=True):
                    for k, text in enumerate(t):
                        f[k] += index.occurrences(text)
                vars(block).pop("_value", None)  # read again when it is needed: one block in memory
            yield from zip(held, ([sorted(x) for x in f] for f in found), strict=True)
            held, size = [], 0


def _indexes(benchmark: DataFrame) -> list:
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(Index(block)) for block in _blocks(benchmark)]


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, least_edits, spans (item:start:end, each place); a row for each row of ``docs``."""
    ready(docs.sparkSession)
    sent = _indexes(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _found(sent, batches):
            cols = [
                b.column("doc_id"), pa.array([bool(f) for f in found], pa.bool_()), pa.array([len({x[0] for x in f}) for f in found], pa.int64()),
                pa.array([min((x[3] for x in f), default=None) for f in found], pa.int64()), pa.array([",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in f) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "contaminated", "n_items", "least_edits", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, contaminated boolean, n_items long, least_edits long, spans string")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows."""
    ready(docs.sparkSession)
    sent = _indexes(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _found(sent, batches):
            yield b.filter(pa.array([not f for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
