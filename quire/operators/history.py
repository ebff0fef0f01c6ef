"""Version histories: offset pairs, change enumeration, bag differences, chains and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_gap_pairs(versions: DataFrame, path: str, order: str, content: str, gap: int) -> DataFrame:
    """(path, version, later version ``gap`` steps on, whether the content is the same)."""
    w = Window.partitionBy(path).orderBy(order)
    rows = versions.select(path, F.col(order).alias("before"), F.lead(order, gap).over(w).alias("after"), F.sha2(content, 256).alias("b"), F.lead(F.sha2(content, 256), gap).over(w).alias("a"))
    return rows.where("after is not null").select(path, "before", "after", (F.col("a") == F.col("b")).alias("same"))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either bag without a partner in the other: side, columns, number."""
    columns = left.columns
    side = lambda a, b, name: a.exceptAll(b).groupBy(*columns).agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    return side(left, right, "left").unionByName(side(right, left, "right"))


def unique_key_pairs(base: DataFrame, current: DataFrame, snapshot: list[str], key: str) -> DataFrame:
    """Pairs of positions whose key is unique in its own snapshot on both sides."""
    once = lambda rows, name: rows.groupBy(*snapshot, key).agg(F.count("*").alias("n"), F.min("pos").alias(name)).where("n = 1").drop("n")
    return once(base, "base_pos").join(once(current, "cur_pos"), [*snapshot, key])


def gap_bounds(rows: DataFrame, partition: list[str], order: str, chain_pos: Column) -> DataFrame:
    """The nearest chain positions before and after each row: an as-of join both ways."""
    w = Window.partitionBy(*partition).orderBy(order)
    before = F.last(chain_pos, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy(*partition).orderBy(F.desc(order))  # a frame that only grows
    after = F.last(chain_pos, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("gap_before", F.coalesce(before, F.lit(-1))).withColumn("gap_after", after)
