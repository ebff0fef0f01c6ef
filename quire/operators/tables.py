"""Written tables of the engine's operators: they cut lineage in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder; where none is configured, a temporary one in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` over all tasks that the session shuffles into.

    Where a kernel takes long for few bytes, partitions merged by size would be too few.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def busy(rows: DataFrame, *keys: str) -> DataFrame:
    """As :func:`spread`, over four tasks a core at least: a kernel whose rows differ much in cost then ends evenly on all of them."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *[F.col(f"`{k}`") for k in keys])


def _drop(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what stands above starts from files that outlive any executor."""
    path = f"{folder(df.sparkSession)}/quire/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
