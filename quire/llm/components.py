"""Connected components over edge tables, by alternating large-star and small-star steps.

Each step only takes a minimum per node (combined before the shuffle) and joins it back, so a hub
with any number of edges is one row on the reduced side, and the join may be split on the other.
Every round's edges are written to the shared folder: lost executors repeat one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    up = both.where("v > u")
    return up.join(low, up["u"] == low["w"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = down.join(low, down["u"] == low["w"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node with an edge, and the smallest node it reaches.

    Loops, nulls, repeated and reversed edges change nothing; no edges give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = shared.cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        then = shared.cut(_small(_large(now)), "edges")
        after = _mark(then)
        shared.uncut(now)
        now = then
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
