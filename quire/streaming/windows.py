"""Windowed counts over an event table or stream (beyond the reference's own operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, key: str, late: str | None = None) -> DataFrame:
    """(key, start, n) per tumbling window; on a stream, ``late`` bounds how late rows may come."""
    rows = events.withWatermark(ts, late) if late else events
    per = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return per.select(key, F.col("w.start").alias("start"), "n")


def first_answers(answers: DataFrame, ts: str, key: str, within: str) -> DataFrame:
    """On a stream, the first row of each key; state is dropped once the watermark has passed."""
    return answers.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
