"""Batches that text kernels hand to workers."""

import pytest
from pyspark.sql import functions as F

from quire.functions import kernels
from quire.operators import checker, documents

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def default(spark):
    old = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.set(KEY, old)


KERNELS = {
    "nfc": lambda: kernels.nfc("text"),
    "edit": lambda: documents.delete_block(F.col("text"), F.array(F.lit(0))),
    "parse": lambda: documents.parse("text"),
}


@pytest.mark.parametrize("name", KERNELS)
def test_text_kernels_bound_their_batches(default, name):
    KERNELS[name]()
    assert int(default.conf.get(KEY).removesuffix("b")) == kernels.BATCH_BYTES
    default.conf.set(KEY, "5m")
    KERNELS[name]()
    assert default.conf.get(KEY) in ("5m", "5242880b")


def test_batches_of_long_texts_are_small(default):
    """300 texts of 100 kB fit Spark's own bound of rows; a worker now takes some 10 at a time."""
    kernels.bound_batches()
    size = F.pandas_udf(lambda x: x.map(lambda _: len(x)), "int")
    rows = default.range(300, numPartitions=1).select(size(F.repeat(F.lit("x"), 100_000)).alias("n"))
    assert rows.agg(F.max("n")).first()[0] <= 30


def test_the_checker_bounds_its_batches(default):
    checker.verdicts(default.createDataFrame([("a.md", "x")], "path string, text string"))
    assert int(default.conf.get(KEY).removesuffix("b")) == kernels.BATCH_BYTES
