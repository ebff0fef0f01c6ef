"""Text reports, manifests and write-once outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """(line): ``sha256  path`` of each (path, content), sorted by path."""
    return files.orderBy("path").select(F.concat_ws("  ", F.sha2("content", 256), "path").alias("line"))


def markdown_row(*columns: Column | str) -> Column:
    """A table row: cells with their pipes escaped, null as an empty cell."""
    cells = [F.replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def write_once(rows: DataFrame, path: str, fmt: str = "json", **options: str) -> None:
    """Write a sealed output; an existing one is an error, never overwritten."""
    rows.write.format(fmt).options(**options).mode("errorifexists").save(path)


def append(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Add rows to a ledger; rows there stay as they are."""
    rows.write.format(fmt).mode("append").save(path)


def packets(rows: DataFrame, path: str, packet: str = "packet") -> None:
    """One folder of JSON lines a packet (``packet=...``); rows of a packet are spread over the tasks that hold them."""
    rows.write.format("json").partitionBy(packet).mode("errorifexists").save(path)
