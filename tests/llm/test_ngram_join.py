import random
import re

import numpy as np
import pytest

from docsieve.llm import ngram_join as J
from docsieve.llm.kernels import shingle_sets, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.ngram_join(df).collect()), key=str)


def family(rng, n, length, edits, vocabulary=40):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"e{rng.randrange(vocabulary)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = family(rng, 40, 120, 6) + family(rng, 25, 60, 3) + family(rng, 10, 400, 12) + ["same text here again and again"] * 7 + family(rng, 10, 8, 1)
    line = " common line that is in very many of all documents here"
    texts = [t + line if k % 3 == 0 else t for k, t in enumerate(texts)]
    texts += [None, "", "  \t\n", "one", "one", "ONE", "a b c d", "A b  C\td", "é É x y z", "x" * 5000, "n " * 300]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_long_text_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 400)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 60, 50, 4) + [" ".join(f"v{k}" for k in range(60_000))] * 2))
    assert run(spark, rows) == brute(rows)


def test_empty_and_odd_rows(spark):
    assert run(spark, []) == []
    rows = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (4, "")]
    assert run(spark, rows) == sorted([(None, 2, 3), (None, 0, None), (3, 2, 3), (3, 2, 3), (4, 0, 4)], key=str)


def test_null_ids_near_copies_and_chains(spark):
    w = [f"w{k}" for k in range(100)]
    near = lambda *at: " ".join("z" if k in at else x for k, x in enumerate(w))
    rows = [(1, near()), (None, near(99))]
    assert run(spark, rows) == brute(rows) and {r[2] for r in run(spark, rows)} == {1}
    rows = [(1, near()), *[(None, near(0, 20))] * 3, (9, near(0, 20, 50, 70)), (None, "x " + near(7, 13, 30, 60, 90)), (None, None), (None, "")]
    assert run(spark, rows) == brute(rows)
    assert len(shingles(rows[0][1]) & shingles(rows[4][1])) * 100 < 80 * len(shingles(rows[0][1]) | shingles(rows[4][1]))
    assert [c for d, _, c in run(spark, rows) if d == 9] == [1]
    texts = family(random.Random(6), 30, 60, 4)
    rows = [(None if k % 3 else k, t) for k, t in enumerate(texts)]
    assert run(spark, rows) == brute(rows)


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "x"), (2, "A b c d e f", "y"), (2, "A b c d e f", "y"), (7, "", "z"), (None, "a b c d e f", "n"), (9, "q r s t u v w", "w"), (8, None, "v")]
    out = J.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, _q_key string"))
    assert out.columns == ["doc_id", "text", "_q_key"]
    assert sorted((r[0] or 0, r[2]) for r in out.collect()) == [(0, "n"), (2, "y"), (7, "z"), (8, "v"), (9, "w")]


def test_keep_one_of_repeated_ids(spark):
    rows = [(1, "a b c d e f", "a"), (5, "a b c d e f", "copy"), (5, "q r s t u v w", "q"), (5, "", "empty"), (5, "g h i j k l", "g"), (5, "G h i j k l", "g")]
    out = J.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, name string"))
    assert sorted((r[0], r[2]) for r in out.collect()) == [(1, "a"), (5, "empty"), (5, "g"), (5, "q")]


def test_hot_groups_and_report(spark, monkeypatch):
    """Groups in many parts, trees and blocks; the counts of the report."""
    from docsieve.llm import common, components

    monkeypatch.setattr(common, "PART", 5)
    monkeypatch.setattr(J, "TREE", 7)
    monkeypatch.setattr(J, "BLOCK", 900)
    monkeypatch.setattr(J, "MEMBERS", 6)
    rng = random.Random(11)
    start = [f"s{k}" for k in range(12)]
    texts = family(rng, 50, 90, 7)
    for _ in range(60):  # these share rare shingles but not more
        texts.append(" ".join(start + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 60))]))
    chain = start + [f"c{k}" for k in range(100)]
    for k in range(0, 40, 2):
        chain[30 + k] = f"d{k}"
        texts.append(" ".join(chain))
    rows = list(enumerate(texts + texts[:9]))
    assert run(spark, rows) == brute(rows)
    report: dict = {}
    found = J.joined(spark.createDataFrame(rows, "doc_id bigint, text string"), report)
    assert found.count() == len(rows) and report["candidates"] > 0 and report["bounded"] >= report["verified"] >= report["linked"] > 0, report
    monkeypatch.setattr(components, "ROUNDS", 2)
    with pytest.raises(RuntimeError, match="rounds"):
        run(spark, rows)


def test_words_by_pieces(monkeypatch):
    import docsieve.llm.kernels as K

    raw = np.frombuffer("ab  cd é\tx y".encode() * 50, np.uint8)
    at = np.array([0, 30, 30, 200, len(raw)])
    want = words(raw, at)
    monkeypatch.setattr(K, "_CHUNK", 7)
    got = K.words(raw, at)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()
    assert [len(s) for s in shingle_sets(raw, at)][1] == 0


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_all(seed):
    rng = np.random.default_rng(seed)
    points = rng.poisson(4, (120, 32)).astype(np.int64)
    points[40:80] = points[:40] + (rng.random((40, 32)) < 0.1)
    comp = rng.integers(0, 60, 120)
    got = {tuple(sorted(p)) for i, j in J.CountTree(points, comp).pairs() for p in zip(i.tolist(), j.tolist(), strict=True)}
    size = points.sum(1)
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if comp[a] != comp[b] and np.minimum(points[a], points[b]).sum() >= J.need(size[a], size[b])}
    assert {(a, b) for a, b in want if 5 * size[a] >= 4 * size[b] and 5 * size[b] >= 4 * size[a]} <= got


@pytest.mark.parametrize("seed", range(5))
def test_tree_asked(seed):
    rng = np.random.default_rng(seed)
    points = rng.poisson(3, (300, 32)).astype(np.int64)
    point = rng.poisson(3, 32).astype(np.int64)
    points[100:140] = point + (rng.random((40, 32)) < 0.15)
    got = set(J.CountTree(points, np.arange(300)).near(point).tolist())
    size, m = points.sum(1), point.sum()
    within = (5 * size >= 4 * m) & (5 * m >= 4 * size) & (np.minimum(points, point).sum(1) >= J.need(size, m))
    assert got == set(np.flatnonzero(within).tolist()) and len(got) >= 40


@pytest.mark.parametrize("bits", [J.BITS, 1])
def test_bit_sets(monkeypatch, bits):
    monkeypatch.setattr(J, "BITS", bits)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 200 - 3 * k], rng.integers(0, 2**63, 2 * k + 1).astype(np.uint64)))) for k in range(20)]
    i, j = np.triu_indices(20, 1)
    got = J.Sets(sets).similar(i, j)
    for a, b, g in zip(i, j, got, strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert g == (100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both))
