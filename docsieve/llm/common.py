"""What the operators share: scratch tables, size-checked joins, Arrow text access."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of white space that part words: space and 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of 8 to 16 bytes that a broadcast side may have; beyond it, a shuffle join runs.
BROADCAST_ROWS = 1_000_000
#: Bytes in one Arrow batch (a longer row is one of its own): bounds a Python worker's memory, however long texts are.
BATCH_BYTES = 8 << 20
#: A key is hot if it has more than one in SHARE of all rows, so that there are fewer than SHARE hot keys.
SHARE = 4096
#: Rows of one key that stay together in any case.
PART = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session without the setting gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docsieve-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for a URI."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    They survive lost executors. ``drop`` removes one as soon as it is of no
    more use; the rest go when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def free(self) -> None:
        """Lets Spark remove shuffle files of steps whose tables are written."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Bounds Arrow batches, unless the session bounds them itself, and sends this package to the executors once."""
    if _BYTES not in spark.conf.getAll:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_docsieve_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="docsieve-code-"), "docsieve.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in root.rglob("*.py"):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._docsieve_sent = True


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A join that broadcasts ``right`` only after counting at most ``rows`` rows there."""
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """key, _parts of the keys that are to be split, given (key, n); None if there are none, as mostly.

    A hot key has over one in SHARE of all rows, so there are fewer than SHARE, however many keys there are."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    least = max(PART, (total or 0) // SHARE)
    if (most or 0) <= least:
        return None
    hot = counts.where(F.col("n") > least).select(key, "n").collect()
    return counts.sparkSession.createDataFrame([(r[0], r["n"] // least + 1) for r in hot], f"`{key}` {dict(counts.dtypes)[key]}, _parts int")


def with_parts(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``df`` with ``_parts``: over how many parts the row's key is dealt."""
    if hot is None:
        return df.withColumn("_parts", F.lit(1))
    return df.join(F.broadcast(hot.toDF(key, "_hot")), key, "left").withColumn("_parts", F.coalesce("_hot", F.lit(1))).drop("_hot")


def split_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """A join on ``on``, in which the rows of ``left`` that have one hot key (of column ``on[0]``) are dealt over as
    many parts as ``hot`` says, by a hash of ``by``; the few rows of ``right`` with that key go to each part."""
    if hot is None:
        return left.join(right, on, how)
    dealt = with_parts(left, on[0], hot).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    copied = with_parts(right, on[0], hot).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_part"], how).drop("_part")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes (UTF-8) of an Arrow string array and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]
