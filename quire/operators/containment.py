"""Containment of tree nodes: which nodes lie under some of a set of roots.

A node's path lists its place among its siblings, from the top down; it lies under a root if the root's path
begins its own, a root lying under itself. Paths are written as keys that sort as the tree is read, so what
lies under a root is an interval behind it. Intervals nest or are apart: in reading order, a node lies under
a root exactly if the farthest interval begun so far hasn't ended. One sort a document, no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits of a place in a key.
WIDTH = 10


def node_key(path: Column) -> Column:
    """A text that sorts as the tree is read; places are integers from 0."""
    return F.array_join(F.transform(path, lambda k: F.lpad(k.cast("string"), WIDTH, "0")), "")


def under(nodes: DataFrame, tree: str | list[str], path: str, is_root: Column) -> DataFrame:
    """``nodes`` with ``root``: the path of the outermost root that each lies under, null without one."""
    keys = [tree] if isinstance(tree, str) else tree
    key = node_key(F.col(path))
    # beyond every key that goes on from this one, whose next character is a digit
    end = F.when(is_root, F.struct(F.concat(key, F.lit("~")).alias("end"), F.col(path).alias("path")))
    reading = Window.partitionBy(*keys).orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = nodes.withColumn("__key", key).withColumn("__end", end)
    rows = rows.withColumn("__far", F.max("__end").over(reading))
    return rows.withColumn("root", F.when(F.col("__far.end") > F.col("__key"), F.col("__far.path"))).drop("__key", "__end", "__far")
