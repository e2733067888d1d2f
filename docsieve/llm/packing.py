"""Packing of token sequences by minimum bin slack.

A document longer than a window is cut into full windows; what remains of each
is a piece shorter than that. A window is filled around the longest remaining
piece: dynamic programming over the multiset of remaining lengths, on bitsets
of reachable sums, finds the multiset that comes closest to the capacity, and
backtracking gives how many pieces of each length it takes.

Pieces are packed where they are read: each task keeps a pool of at most ``POOL``
pieces, so there is no shuffle, memory is bounded and a lost task is made again
alike. What is left at a task's end in an incomplete window is cut into
sequences whose lengths are powers of two, which need no padding.

A null or empty text is the end id alone. Repeated rows and doc_ids are packed
one by one; a null doc_id stays null. ``sequence_id`` is unique, not gapless.

Ids are those of the tokenizer file. Whole texts are encoded by a second public
library that reads the same vocabulary and merges as ranks, which is about five times as
fast as the tokenizer itself. Texts that the two could take differently (with a special token's
name) or that the second can't take (its patterns recurse over long runs of white space) are
encoded by the tokenizer.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

WINDOW = 1024
POOL = 16_384
#: White space characters in a row from which on the tokenizer itself encodes a text.
SPACES = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_loaded: dict[tuple[str, str], tuple] = {}


class Encoder:
    """Ids of whole texts, as bytes."""

    def __init__(self, tokenizer_file: str, ranks_file: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(tokenizer_file)
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([rf"\s{{{SPACES}}}", *special])).search

    def __call__(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids if self.odd(text) else self.ranked(text)
        return np.array(ids, "<u4").tobytes()


def encoder(tokenizer_file: str, ranks_file: str) -> Encoder:
    key = (tokenizer_file, ranks_file)
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of ``counts`` (length: how many there are), the multiset whose sum is closest to ``capacity`` from below.

    A length with count c is taken in portions of 1, 2, 4, ... pieces, so that any
    number up to c can be reached. Stops as soon as the capacity itself can be."""
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity and counts[x] > 0), reverse=True):
        left, portion = min(counts[length], capacity // length), 1
        while left:
            take = min(portion, left)
            after = reach | (reach << (take * length)) & full
            if after != reach:
                steps.append((reach, length, take))
                reach = after
            left, portion = left - take, portion * 2
        if reach >> capacity & 1:
            break
    best, used = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            best -= take * length
            used[length] += take
    return dict(used)


class Packer:
    """Packs pieces of one task; ``rows`` collects (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, pool: int, first_sequence: int):
        self.window, self.pool, self.sequence = window, pool, first_sequence
        self.pieces: dict[int, list[tuple]] = defaultdict(list)  # by length: doc_id, start, ids, doc_tokens
        self.counts: dict[int, int] = {}
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        for start in range(0, total, self.window):
            piece = ids[4 * start : 4 * (start + self.window)]
            if len(piece) == 4 * self.window:
                self._place([(doc_id, start, piece, total)])
            else:
                n = len(piece) // 4
                self.pieces[n].append((doc_id, start, piece, total))
                self.counts[n] = self.counts.get(n, 0) + 1
                self.held += 1
        if self.held > self.pool:
            self._pack(self.pool // 4)

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.held -= 1
        return self.pieces[length].pop()

    def _pack(self, least: int) -> None:
        """Fills windows until at most ``least`` pieces are left."""
        while self.held > least:
            chosen = [self._take(max(self.counts))]
            for length, n in fill(self.counts, self.window - len(chosen[0][2]) // 4).items():
                chosen += [self._take(length) for _ in range(n)]
            slack = self.window - sum(len(p[2]) for p in chosen) // 4
            if slack and self.held:  # all that is left is longer than the slack: a cut fills it
                doc_id, start, ids, total = self._take(min(self.counts))
                chosen.append((doc_id, start, ids[: 4 * slack], total))
                rest = (doc_id, start + slack, ids[4 * slack :], total)
                n = len(rest[2]) // 4
                self.pieces[n].append(rest)
                self.counts[n] = self.counts.get(n, 0) + 1
                self.held += 1
            if slack and not self.held and len(chosen) and sum(len(p[2]) for p in chosen) < 4 * self.window:
                self._last(chosen)
            else:
                self._place(chosen)

    def _last(self, chosen: list[tuple]) -> None:
        """Cuts an incomplete window into sequences of lengths that are powers of two."""
        left = sum(len(p[2]) for p in chosen) // 4
        queue = list(reversed(chosen))
        while left:
            size, now = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc_id, start, ids, total = queue.pop()
                n = min(size, len(ids) // 4)
                now.append((doc_id, start, ids[: 4 * n], total))
                if n < len(ids) // 4:
                    queue.append((doc_id, start + n, ids[4 * n :], total))
                size -= n
            self._place(now)

    def finish(self) -> None:
        self._pack(0)


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str, end_id: int = 0, window: int = WINDOW, pool: int = POOL) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The files are paths on each executor. A sequence id is the task's number
    times 2**36 plus a number in the task."""
    ready(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file, ranks_file)
        packer = Packer(window, pool, (TaskContext.get().partitionId()) << 36)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                packer.add(doc_id, encode(text or "") + end)
            yield out()
        packer.finish()
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
