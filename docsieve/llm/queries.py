"""The queries of these operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, line_dedup, ngram_join, packing, pii, quality, secrets, sharding, warc
from .common import Scratch

#: Targets of op5: shards of at most 8 MB, whatever the scan's pieces are, merged into files of about 64 MB.
SHARD_TARGET, SHARD_FAN, SHARD_SMALL = 64 << 20, 4, 8 << 20
#: Arrivals that op5 appends the table in, by a hash of doc_id.
SHARD_ARRIVALS = 4


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary that the packing queries use, as the tokenizer's file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), *tokenizer_files())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_docs(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return langid.identify(docs, langid.train(langid.training_rows(docs)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_docs(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the table in small shards, an arrival at a time, compacts after each, and reads all rows of the last version."""
    store = sharding.Store(spark, Scratch(spark, "store").root, SHARD_TARGET, SHARD_FAN, SHARD_SMALL)
    docs = _docs(spark, sf_dir)
    for k in range(SHARD_ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARD_ARRIVALS)) == k), SHARD_SMALL)
        store.compact()
    store.vacuum()
    rows = store.read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_docs(spark, sf_dir)).select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.withColumn("block", F.col("block").cast("string"))  # text in both kinds


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_docs(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": "SELECT doc_id, lang, source, n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents", "op9_line_dedup": line_dedup.ORACLE_SQL}
