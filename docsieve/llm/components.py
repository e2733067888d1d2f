"""Connected components by alternating stars (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART, Scratch, hot_keys, split_join

#: Rounds after which something must be wrong: their number grows with the logarithm of the longest path.
ROUNDS = 64


def connected(out: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """node, comp (smallest node that it is connected with) for each node of ``edges`` (a, b).

    A round is two aggregations with map-side combine and two joins; the number
    of rounds grows with the logarithm of the longest path."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = out.table(now, f"{name}-0")
    state = _state(now)
    for k in range(1, ROUNDS):
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hubs = hot_keys(both.groupBy("u").agg(F.count("*").alias("n")), "u") if 2 * state[0] > PART else None
        large = split_join(both.where("v > u"), least, ["u"], hubs, "v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = out.table(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        out.drop(f"{name}-{k - 1}")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components aren't found after {ROUNDS} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
