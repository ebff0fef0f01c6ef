"""Functions without a built-in form, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Bytes of texts that a worker takes at a time, and Spark's own bound.
BATCH_BYTES = 2 << 20
SPARK_BYTES = "67108864b"


def bound_batches() -> None:
    """Hand texts to workers in batches of at most ``BATCH_BYTES``, unless the session says otherwise.

    Spark's default of 64 MB or 10,000 rows is held by each worker as Arrow data, strings, trees and results at once.
    """
    conf, key = SparkSession.active().conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, SPARK_BYTES) == SPARK_BYTES:
        conf.set(key, str(BATCH_BYTES))


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column | str) -> Column:
    """NFC normalisation; null stays null."""
    bound_batches()
    return _nfc(text)
