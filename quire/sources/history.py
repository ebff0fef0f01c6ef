"""Exported version history as tables, and what is asked of them.

History is exported out of band into a folder; nothing here runs another program:
- ``parents``: lines ``commit parent parent ...``, children before parents;
- ``authors``: lines ``commit NUL name <address>``;
- ``changes``: NUL-separated ``commit, (status, path[, new path])...``, commit after commit;
- ``blobs``: lines ``object type commit:path``, or ``commit:path missing``.

``spark.read.format("quire_history")`` reads ``changes`` in byte ranges, so a long export is many tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from quire.operators import tables

STATUS = re.compile(rb"[ACDMRTUX][0-9]*\Z")
OBJECT = re.compile(rb"(?:[0-9a-f]{40}|[0-9a-f]{64})\Z")
RANGE_BYTES = 32 << 20


def _open(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else os.path.abspath(path))
    return store.open_input_file(name)


class _Range(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class _ChangeReader(DataSourceReader):
    """Ranges of a change list. A range owns the commits whose first byte lies in it."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.commit = path, size, None

    def pushFilters(self, filters):  # noqa: N802  the data source's name for it
        """A wanted commit is looked for in the bytes; the filter stays in the plan as well."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("commit",):
                self.commit = f.value
            yield f

    def partitions(self):
        with _open(self.path) as f:
            total = f.size()
        return [_Range(a, min(a + self.size, total)) for a in range(0, total, self.size)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        commit, rows, wanted = "", [], None if self.commit is None else self.commit.encode()
        for token, rest in _commits(self.path, partition.begin, partition.end):
            if wanted is not None and token != wanted:
                continue
            commit = token.decode()
            for status, paths in rest:
                rows.append((commit, status.decode(), [p.decode("utf-8", "replace") for p in paths]))
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))], names=["commit", "status", "paths"])


def _tokens(path: str, begin: int) -> Iterator[tuple[int, bytes]]:
    """(place, token) from the first one that starts at or behind ``begin``."""
    with _open(path) as f:
        f.seek(max(begin - 1, 0))
        at, held = max(begin - 1, 0), b""
        skip = begin > 0  # what stands before the first NUL began earlier
        while piece := f.read(1 << 20):
            held += piece
            *whole, held = held.split(b"\0")
            for token in whole:
                if not skip:
                    yield at, token
                skip = False
                at += len(token) + 1
        if held and not skip:
            yield at, held


def _commits(path: str, begin: int, end: int) -> Iterator[tuple[bytes, list[tuple[bytes, list[bytes]]]]]:
    """Commits that start in a range, with their changes. An object id that follows a status is a path."""
    commit, rest, before, due = None, [], b"\0", 0
    for at, token in _tokens(path, begin):
        if not token:
            continue
        if due:
            rest[-1][1].append(token)
            due -= 1
        elif commit is not None and STATUS.match(token):
            rest.append((token, []))
            due = 2 if token[:1] in b"RC" else 1
        elif OBJECT.match(token) and not STATUS.match(before):
            if commit is not None:
                yield commit, rest
            if at >= end:
                return
            commit, rest = token, []
        before = token
    if commit is not None:
        yield commit, rest


class HistorySource(DataSource):
    """Options: ``path`` of the change list, ``rangeBytes`` of a partition."""

    @classmethod
    def name(cls) -> str:
        return "quire_history"

    def schema(self) -> str:
        return "commit string, status string, paths array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _ChangeReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))


def changes(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(commit, status, paths) of an exported change list."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HistorySource)
    return spark.read.format("quire_history").option("path", path).option("rangeBytes", range_bytes).load()


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(commit, parents, author) of exported parent and author lists; an unknown author is null."""
    words = F.split("value", " ")
    parents = spark.read.text(f"{folder}/parents").where("value <> ''").select(words[0].alias("commit"), F.slice(words, F.lit(2), F.size(words)).alias("parents"))
    cut = F.split("value", "\0", 2)
    authors = spark.read.text(f"{folder}/authors").where("value <> ''").select(cut[0].alias("commit"), cut[1].alias("author"))
    return parents.join(authors, "commit", "left")


def blob_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(commit, path, oid): the blob at a path in a commit; null where there is none or it is no blob."""
    found = F.regexp_extract("value", r"^(?:([0-9a-f]+) ([a-z]+) )?([0-9a-f]+):(.*?)( missing)?$", 0) != ""
    part = lambda k: F.regexp_extract("value", r"^(?:([0-9a-f]+) ([a-z]+) )?([0-9a-f]+):(.*?)( missing)?$", k)
    return spark.read.text(f"{folder}/blobs").where(found).select(part(3).alias("commit"), part(4).alias("path"), F.when((part(2) == "blob"), part(1)).alias("oid"))


def ancestors(commits: DataFrame, pins: DataFrame) -> DataFrame:
    """(pin, commit): every commit that a pin reaches over parents, itself included.

    First parents form chains, along which pointers double: table k holds for each commit the one 2^k steps
    on, a row a commit, so the longest chain takes a logarithm of its length in rounds. What a pin reaches
    along chains then hands on the other parents of merges, and so on until these bring nothing new: one
    more turn for each side line that hangs on another side line.
    """
    known = tables.written(commits.select("commit", F.get("parents", F.lit(0)).alias("to")).distinct(), "first-parents")
    more = commits.select(F.col("commit").alias("a"), F.explode(F.slice("parents", F.lit(2), F.greatest(F.size("parents") - 1, F.lit(0)))).alias("b")).distinct()
    more = tables.written(more, "other-parents")
    step, steps = tables.written(known.where("to IS NOT NULL").select(F.col("commit").alias("a"), F.col("to").alias("b")), "jumps"), []
    many = known.count()
    while not step.isEmpty():
        if 1 << len(steps) > many:
            raise ValueError("a commit is its own ancestor")
        steps.append(step)
        step = tables.written(step.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "jumps")
    reached = None
    new = tables.written(pins.select(F.col("commit").alias("pin"), "commit").distinct(), "reached")
    while not new.isEmpty():
        for step in steps:
            far = new.join(step, new["commit"] == step["a"]).select("pin", F.col("b").alias("commit"))
            new = tables.written(new.union(far).distinct(), "reached")
        reached = new if reached is None else tables.written(reached.union(new).distinct(), "reached")
        side = new.join(more, new["commit"] == more["a"]).select("pin", F.col("b").alias("commit")).distinct()
        new = tables.written(side.join(reached, ["pin", "commit"], "left_anti"), "reached")
    if reached is None:
        return new
    return reached.join(known.select("commit"), "commit", "left_semi").select("pin", "commit")


def path_history(changes: DataFrame, order: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(path, version, commit): the commits that touch a path, oldest first, a move touching both of its paths.

    ``order`` holds (commit, place) of the commits that count, the oldest with the least place, such as the
    ancestors of a pin without merges; ``wanted`` restricts the paths.
    """
    each = changes.select("commit", F.explode("paths").alias("path")).distinct()
    if wanted is not None:
        each = each.join(wanted.select("path").distinct(), "path", "left_semi")
    rows = each.join(order.select("commit", "place"), "commit")
    version = F.row_number().over(Window.partitionBy("path").orderBy("place", "commit")) - 1
    return rows.select("path", version.alias("version"), "commit")


def blob_at(history: DataFrame, blobs: DataFrame) -> DataFrame:
    """``history`` (path, version, commit) with the blob's ``oid``, null where the commit holds none at the path."""
    return history.join(blobs.select("path", "commit", "oid").distinct(), ["path", "commit"], "left")
