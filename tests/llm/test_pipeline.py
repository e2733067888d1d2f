import re

import corpus_pipeline
import odd

from docsieve.llm import decontam, quality
from docsieve.llm.common import Scratch

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark):
    out = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = out.table(stage(spark, spark.createDataFrame(list(before.values()), docs.schema), DATA), f"{k}-{name}")
        if k == 4:
            assert {r["doc_id"] for r in after.collect()} == set(before)
            break
        assert after.columns == docs.columns
        now = {r["doc_id"]: r for r in after.collect()}
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality.verdicts(docs).where("kept").collect()}
            assert set(now) == kept and 0 < len(kept) < len(before)
        elif name == "line_dedup":
            assert set(now) == set(before) and all(r["n_chars"] == len(r["text"]) for r in now.values())
        elif name == "near_duplicates":
            sets = {d: shingles(r["text"]) for d, r in before.items()}
            up = {d: d for d in sets}

            def root(x, up=up):
                while up[x] != x:
                    x = up[x]
                return x

            for a in sorted(sets):
                for b in sets:
                    both = len(sets[a] & sets[b])
                    if a < b and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        up[y] = x
            assert set(now) == {d for d in sets if not sets[d] or root(d) == d}
        elif name == "decontamination":
            bench = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            hit = {d for d, r in before.items() if any(b in decontam.normal(r["text"]) for b in bench)}
            assert hit and not hit & set(now) and len(now) >= len(before) - len(hit) - 2
        before = now
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_odd_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        for df in (odd.frame(spark), odd.empty(spark)):
            stage(spark, df, DATA).count()
