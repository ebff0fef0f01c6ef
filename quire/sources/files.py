"""Files of a tree as tables, from any store that Spark reads.

Names and folders are tested on the scan's metadata, so files that don't qualify are never opened. Spark's scans
leave empty files out; they are added from the scan's own listing, which the driver holds anyway (one path a file).
Names that begin with ``_`` or ``.`` are reserved in Spark's listings and not seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no documents, and the suffix of one.
SKIPPED = (".git", ".hg", ".svn", ".venv", "node_modules", "__pycache__")
SUFFIX = "*.[mM][dD]"


def _below(path: Column, root: str) -> Column:
    """The path below ``root``, whatever scheme the store puts before it."""
    place = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    bare = "/" + root.split(":", 1)[-1].strip("/") if "://" not in root else None
    return F.substr(place, F.lit(len(bare) + 2)) if bare else F.substr(path, F.lit(len(root.rstrip("/")) + 2))


def tree(spark: SparkSession, root: str, glob: str | None = None, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """(path, content) of every file below a folder; ``path`` is relative to it, ``skipped`` folders are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    scan = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    uri = F.col("_metadata.file_path").alias("uri")
    files = scan.select(uri, "path", "content")
    listed = [(u,) for u in scan.inputFiles() if not glob or fnmatchcase(u.rpartition("/")[2], glob)]
    key = F.regexp_replace("uri", ":/+", ":/").alias("key")  # the listing and the scan spell local paths differently
    sized = scan.select(uri).select(key).distinct()
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    empty = spark.createDataFrame(listed, "uri string").select("uri", key).join(sized, "key", "left_anti").select("uri", plain.alias("path"), F.lit(b"").alias("content"))
    if skipped:
        inside = "|".join(s.replace(".", r"\.") for s in skipped)
        files, empty = (x.where(~F.col("uri").rlike(f"/(?:{inside})/")) for x in (files, empty))
    return files.unionByName(empty).select(_below(F.col("path"), root).alias("path"), "content")


def collect(spark: SparkSession, root: str, named: Sequence[str] = ()) -> DataFrame:
    """(path, content) of the documents below a folder, and of files below it that are named whatever their suffix, each path once."""
    found = tree(spark, root, SUFFIX)
    for name in named:
        one = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{name}")
        content = one.agg(F.coalesce(F.first("content"), F.lit(b"")).alias("content"))  # an empty file gives no row
        found = found.unionByName(content.select(F.lit(name).alias("path"), "content"))
    return found.groupBy("path").agg(F.min("content").alias("content"))


def decoded(files: DataFrame) -> DataFrame:
    """(path, text): strict UTF-8; null where the bytes aren't."""
    text = F.col("content").cast("string")
    return files.select("path", F.when(F.is_valid_utf8(text), text).alias("text"))


def tolerant(files: DataFrame) -> DataFrame:
    """(path, text, clean): bad bytes become U+FFFD and clear the flag."""
    text = F.col("content").cast("string")
    return files.select("path", F.make_valid_utf8(text).alias("text"), F.is_valid_utf8(text).alias("clean"))


def cases(spark: SparkSession, root: str, mark: str) -> DataFrame:
    """(case_id, files): every folder with a file ``mark``, and its files' exact bytes by path inside it.

    A case's files meet in one row, so a case must fit a task; folders of cases don't nest.
    """
    files = tree(spark, root, skipped=())
    cut = F.length("path") - F.lit(len(mark) + 1)
    roots = files.where(F.col("path").endswith("/" + mark)).select(F.substr("path", F.lit(1), cut).alias("case_id"))
    depth = F.size(F.split("path", "/")) - 1
    folders = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    owned = files.where(depth > 0).select("*", F.explode(folders).alias("case_id")).join(roots, "case_id", "left_semi")
    inner = F.struct(F.substr("path", F.length("case_id") + 2).alias("name"), "content")
    return owned.groupBy("case_id").agg(F.map_from_entries(F.collect_list(inner)).alias("files"))
