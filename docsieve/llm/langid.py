"""Language identification: averaged hashed subword embeddings and a linear softmax.

Every run of 2, 3 and 4 bytes of the lower-cased text (words parted by one
space) is hashed to a bucket; the text's vector is the mean of its buckets'
embeddings, and a linear softmax on it gives the languages. Embeddings and
weights are learned together by stochastic gradient descent in numpy. A
temperature fitted on rows that training didn't see calibrates the score, and
the same rows give the score under which a prediction is rejected
(``accepted``).

Training takes about ``per_lang`` rows of each language, in the order of a hash
of doc_id and text, and of each the first ``TRAIN_CHARS`` characters, so the driver holds a sample
that is bounded in rows and bytes. Prediction takes every text whole: it is one pass over all texts without a shuffle: embeddings times
weights is a table of one number for each bucket and language, which is sent to
the executors (buckets x languages x 4 bytes, whatever the corpus).

Only text and a non-null lang of rows in the training folds are learned from.
Text that is null or has no letter is ``und`` with score 0. Without any labelled
row, all is ``und``. Rows are predicted one by one, so repeated ids do no harm; a
null doc_id is in fold crc32("") mod 4 = 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

BUCKETS = 1 << 16
DIM = 16
PER_LANG = 400
TRAIN_CHARS = 20_000
#: Share of the calibration rows that are right but may be rejected.
REJECTED = 0.01
_CHUNK = 1 << 19
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def as_bytes(lowered: str) -> np.ndarray:
    """UTF-8 with runs of white space as one space."""
    raw = np.frombuffer(lowered.encode("utf-8", "surrogatepass"), np.uint8)
    white = _WHITE[raw]
    x = np.where(white, np.uint8(0x20), raw)
    white[1:] &= white[:-1].copy()
    if len(x):
        white[0] = False
    return x[~white]


def tokens(raw: np.ndarray, begin: int | None = None) -> np.ndarray:
    """Buckets of all subwords of bytes that are lower-cased already, or of those that begin in the first ``begin`` bytes."""
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    x = raw.astype(np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
    out = [two[:begin]]
    h = two
    for k in (2, 3):
        if len(x) > k:
            h = h[:-1] * np.uint32(0xC2B2AE35) + x[k:] * np.uint32(0x27D4EB2F)
            out.append(h[:begin])
    h = np.concatenate(out)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)  # BUCKETS of them


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages: what a bucket adds to each logit
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # scores below are rejected

    def logits(self, lowered: str) -> np.ndarray:
        raw = as_bytes(lowered)
        total, n = np.zeros(len(self.langs)), 0
        for a in range(0, max(1, len(raw)), _CHUNK):  # long texts in pieces; a piece reads 3 bytes on
            b = tokens(raw[a : a + _CHUNK + 3], _CHUNK)
            total += np.bincount(b, minlength=BUCKETS).astype(np.float32) @ self.table if len(b) > BUCKETS else self.table[b].sum(0)
            n += len(b)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not any(map(str.isalpha, text)) or not self.langs:
            return "und", 0.0, False
        p = softmax(self.logits(text.lower())[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = 15, rate: float = 8.0, seed: int = 7) -> Model:
    """A model from (text, language) rows; every fifth calibrates."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    label = np.array([langs.index(lang) for _, lang in rows])
    bags = []
    for text, _ in rows:
        b, n = np.unique(tokens(as_bytes(text.lower())), return_counts=True)
        bags.append((b, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, used = (order[::5], np.setdiff1d(order, order[::5])) if len(rows) >= 50 else (order, order)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(used):
            b, f = bags[i]
            v = f @ emb[b]
            p = softmax((v @ w + bias)[None])[0]
            p[label[i]] -= 1
            back = w @ p
            w -= 0.05 * step * np.outer(v, p)
            bias -= 0.01 * step * p
            emb[b] -= step * f[:, None] * back[None]
    model = Model(langs, (emb @ w).astype(np.float32), bias.astype(np.float64))
    z = np.stack([model.logits(rows[i][0].lower()) for i in held])
    y = label[held]
    losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.05, 5, 60)}
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(z / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    model.least = float(right[int(REJECTED * len(right))]) if len(right) else 0.0
    return model


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """About ``per_lang`` rows of each language, and never more than 1.5 times that in all."""
    known = docs.where("lang is not null and text is not null").where(fold() != 2)
    key = F.xxhash64("doc_id", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))))
    drawn = known.where(F.pmod(key, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    rows = drawn.select(F.substring("text", 1, TRAIN_CHARS).alias("text"), "lang", key.alias("k")).orderBy("k", "text").limit(int(1.5 * per_lang * len(counts))).collect()
    return [(r["text"], r["lang"]) for r in rows]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted; a row for each row of ``docs``."""
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.predict(t) for t in b.column("text").to_pylist()]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True))],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
