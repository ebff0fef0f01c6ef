"""Duplicate censuses over the lines of documents.

Adapter: the driver's documents hold no structure beyond lines, so the unit is the non-blank line. Lines are
told apart by digests, which are what is shuffled: a line's length costs nothing beyond its scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_LENGTH = 20
TWIN_BAR_PERCENT = 10


def is_blank(line: Column) -> Column:
    """Only spaces and tabs; a form feed isn't blank."""
    return F.translate(line, " \t", "") == ""


def lines(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """Non-blank lines: the columns ``keep``, ``pos`` (0-based among them) and ``content``."""
    parts = F.filter(F.split(F.col(text_col), "\r\n|\r|\n"), lambda x: ~is_blank(x))
    return docs.select(*keep, F.posexplode(parts).alias("pos", "content"))


def digests(docs: DataFrame, *keep: str, bits: int = 0) -> DataFrame:
    """:func:`lines` with a digest (MD5, or SHA-2 of ``bits``) in place of the content, and ``short``."""
    digest = F.unhex(F.sha2("content", bits)) if bits else F.unhex(F.md5("content"))
    return lines(docs, *keep).select(*keep, "pos", digest.alias("content"), (F.length("content") < MIN_LENGTH).alias("short"))


def twin_census(docs: DataFrame, type_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Per type: short units, distinct long contents, those with a twin in their own document,
    those whose twin is adjacent, and whether twins stay within the bar."""
    every = digests(docs, id_col, type_col)
    short = F.col("short")
    w = Window.partitionBy(id_col, "content").orderBy("pos")
    long = every.where(~short).withColumn("gap", F.col("pos") - F.lag("pos").over(w))
    per_doc = long.groupBy(type_col, "content", id_col).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("gap") == 1, F.lit(False))).alias("adjacent"))
    per_content = per_doc.groupBy(type_col, "content").agg(F.max(F.col("n") > 1).alias("twin"), F.max("adjacent").alias("adjacent"))
    distinct = per_content.groupBy(type_col).agg(F.count("*").alias("distinct_contents"), F.count_if("twin").alias("twins"), F.count_if("adjacent").alias("adjacent_twins"))
    shorts = every.groupBy(type_col).agg(F.count_if(short).alias("short_units"))
    out = shorts.join(distinct, type_col, "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("distinct_contents", "twins", "adjacent_twins")]
    return out.select(type_col, "short_units", *zero).withColumn("bar_ok", F.col("twins") * 100 <= F.col("distinct_contents") * TWIN_BAR_PERCENT)


def uniqueness(docs: DataFrame, type_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Per type, over instances and over distinct contents: all, repeated in a document, in the corpus."""
    per_doc = digests(docs, id_col, type_col).groupBy(type_col, "content", id_col).agg(F.count("*").alias("n"))
    per = per_doc.groupBy(type_col, "content").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_file"))
    return per.groupBy(type_col).agg(
        F.sum("total").alias("instances"),
        F.sum("in_file").alias("in_file_instances"),
        F.sum(F.when(F.col("total") > 1, F.col("total")).otherwise(0)).alias("corpus_instances"),
        F.count("*").alias("contents"),
        F.count_if(F.col("most") > 1).alias("in_file_contents"),
        F.count_if(F.col("total") > 1).alias("corpus_contents"),
    )


def corpus_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Contents that occur twice or more: digest, instances, documents, first document."""
    per_doc = digests(docs, id_col, bits=256).groupBy("content", id_col).agg(F.count("*").alias("n"))
    per = per_doc.groupBy("content").agg(F.sum("n").alias("instances"), F.count("*").alias("documents"), F.min(id_col).alias("first_doc"))
    return per.where("instances > 1").select(F.lower(F.hex("content")).alias("unit"), "instances", "documents", "first_doc")
