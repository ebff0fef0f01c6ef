"""Order-free sampling and first-wins selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import tables

SEED = "prereg2"  # fixed value of the ranking


def rank_of(arm: Column, key: Column) -> Column:
    """A key's rank depends on nothing but itself and its arm."""
    return F.sha2(F.concat(F.lit(f"{SEED}:"), arm, F.lit(":"), key.cast("string")), 256)


def hash_ranked(rows: DataFrame, arm: str, key: str, k: int) -> DataFrame:
    """The k lowest-ranked keys of each arm. Spark keeps k rows a task before it shuffles."""
    w = Window.partitionBy(arm).orderBy("rank", key)
    ranked = rows.withColumn("rank", rank_of(F.col(arm), F.col(key)))
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def first_wins(rows: DataFrame, key: str, order: str, well_formed: Column) -> DataFrame:
    """The first well-formed row of each key binds; how many later or malformed rows it has."""
    per = rows.withColumn("good", well_formed).groupBy(key).agg(
        F.min_by(F.struct("*"), F.when(F.col("good"), F.col(order))).alias("first"),
        F.count_if("good").alias("n_good"),
        F.count_if(~F.col("good")).alias("malformed"),
    )
    return per.where("n_good > 0").withColumn("later", F.col("n_good") - 1)


def deal(rows: DataFrame, order: str, items_per_batch: int, parts: int | None = None) -> DataFrame:
    """Contiguous batches of at most ``items_per_batch`` rows in order, whose sizes differ by one at most.

    Ranges of the order are counted first (a row a range reaches the driver), so a row's place is its place in
    its range behind those of earlier ranges and no task holds the table. Rows of equal order are equal
    neighbours: which comes first is open. The first batches take the extra rows.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, F.col(order), F.xxhash64(*rows.columns)).withColumn("__part", F.spark_partition_id())
    laid = tables.written(laid, "dealt")  # both passes must see one set of ranges, whatever executors are lost
    before, at = {}, 0
    for part, count in sorted(laid.groupBy("__part").count().collect()):
        before[part], at = at, at + count
    batches = -(-at // items_per_batch)
    if not batches:
        return rows.withColumn("batch", F.lit(0))
    offset = F.create_map(*[F.lit(x) for part, count in before.items() for x in (part, count)])
    w = Window.partitionBy("__part").orderBy(order)
    place = F.row_number().over(w) - 1 + F.element_at(offset, F.col("__part"))
    size, extra = divmod(at, batches)
    batch = F.when(place < extra * (size + 1), F.floor(place / (size + 1))).otherwise(extra + F.floor((place - extra * (size + 1)) / max(size, 1))) + 1
    return laid.withColumn("batch", batch.cast("int")).drop("__part")
