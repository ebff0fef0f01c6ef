"""JSON records, history exports and sealed bundles as tables.

History is exported out of band (``rev-list``, ``diff-tree -z --name-status``, ``log``); these readers turn
the exported bytes into rows. Nothing here runs another program.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

CHANGE = re.compile(rb"[ACDMRTUX][0-9]*\Z")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzipped, under a fixed schema; a malformed line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_objects(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One object a file of ``*.json`` in a folder, with the file's name."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("file", F.regexp_extract(F.input_file_name(), "[^/]*$", 0))


def _sorted_type(kind: DataType) -> DataType:
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _sorted_type(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)])
    return ArrayType(_sorted_type(kind.elementType)) if isinstance(kind, ArrayType) else kind


def _ordered(value, kind: DataType):
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType) and _sorted_type(kind.elementType) != kind.elementType:
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    return value


def canonical_json(rows: DataFrame, name: str = "line") -> DataFrame:
    """Each row as one JSON text: keys in code-point order at every depth, no spaces, nulls spelled out."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    whole = F.struct(*[_ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    return rows.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias(name))


def write_canonical(rows: DataFrame, path: str, order: list[str]) -> None:
    """Gzipped canonical JSON lines in global order, so the lines of two runs are the same."""
    lines = canonical_json(rows.orderBy(*order))
    lines.write.option("compression", "gzip").mode("errorifexists").text(path)


def parse_changes(raw: bytes) -> Iterator[tuple[str, str, list[str]]]:
    """(commit, status, paths) of a NUL-separated change list: a commit, then its statuses with one path, or two if moved."""
    tokens, commit = iter(t.decode("utf-8", "surrogateescape") for t in raw.split(b"\0") if t), ""
    for token in tokens:
        if not CHANGE.match(token.encode("utf-8", "surrogateescape")):
            commit = token
            continue
        yield commit, token, [p for _, p in zip(range(2 if token[0] in "RC" else 1), tokens)]


def changes(exports: DataFrame, content: str = "content") -> DataFrame:
    """(commit, status, paths) of exported change lists; a path that isn't UTF-8 shows U+FFFD."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(c, s, [p.encode("utf-8", "replace").decode("utf-8", "replace") for p in ps]) for raw in batch[content] if raw is not None for c, s, ps in parse_changes(bytes(raw))]
            yield pd.DataFrame(found, columns=["commit", "status", "paths"], dtype=object)

    return exports.select(content).mapInPandas(run, "commit string, status string, paths array<string>")


def opened(bundles: DataFrame, expected: DataFrame) -> DataFrame:
    """(arm, ok, reason) of bundles (arm, content) against (arm, sha256): what can't be verified gives no verdict."""
    joined = expected.join(bundles.select("arm", F.sha2("content", 256).alias("found")), "arm", "left")
    reason = F.when(F.col("found").isNull(), "no bundle").when(F.col("found") != F.lower("sha256"), "digest differs")
    return joined.select("arm", reason.isNull().alias("ok"), reason.alias("reason"))


def selected(files: DataFrame, pathspec: str, generated) -> DataFrame:
    """Documents of (path, text) that a pathspec (a regular expression of whole paths) takes and no generator wrote."""
    return files.where(F.col("path").rlike(rf"^(?:{pathspec})$") & F.col("path").rlike(r"(?i)\.md$") & ~generated)
