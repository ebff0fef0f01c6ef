"""One verdict a file, the roll-up, and report lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.functions.kernels import bound_batches
from quire.operators.documents import DOC, describe


def verdicts(files: DataFrame) -> DataFrame:
    """(path, refused, code) of decoded (path, text) files; a null text is refused without a code.

    A column ``unread`` marks files that could not be read: they are neither accepted nor refused.
    A file in ``<document>.notes`` beside its document is an annotation: its links may name anything.
    """
    owners = files.select(F.col("path").alias("owner"), F.lit(True).alias("owned")).distinct()
    owner = F.regexp_extract("path", r"(?s)^(.*)\.notes/[^/]*$", 1)

    @F.pandas_udf(DOC["refusal"].dataType)
    def code(texts: pd.Series, exempt: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else describe(t, not e)["refusal"] for t, e in zip(texts, exempt, strict=True)], dtype=object)

    bound_batches()
    known = files if "unread" in files.columns else files.withColumn("unread", F.lit(False))
    known = known.withColumn("owner", owner).join(owners, "owner", "left")
    found = known.select("path", "unread", F.col("text").isNull().alias("broken"), code("text", F.coalesce("owned", F.lit(False))).alias("code"))
    return found.select("path", (~F.col("unread") & (F.col("broken") | F.col("code").isNotNull())).alias("refused"), F.when(~F.col("unread"), F.col("code")).alias("code"), "unread")


def summary(found: DataFrame) -> DataFrame:
    """(checked, refused, unreadable, exit_code): 1 if any file is refused, else 2 if one is unreadable or there is none, else 0."""
    counts = found.agg(F.count_if(~F.col("unread")).alias("checked"), F.count_if("refused").alias("refused"), F.count_if("unread").alias("unreadable"))
    return counts.withColumn("exit_code", F.when(F.col("refused") > 0, 1).when((F.col("unreadable") > 0) | (F.col("checked") == 0), 2).otherwise(0))


def report(found: DataFrame, annotated: bool = False) -> DataFrame:
    """(path, line) of each refused file, plain or as a workflow annotation."""
    message = F.when(F.col("code").isNull(), "is not UTF-8").otherwise("is outside the profile")
    suffix: Column = F.when(F.col("code").isNull(), "").otherwise(F.concat(F.lit(" ["), "code", F.lit("]")))
    plain = F.concat("path", F.lit(": "), message, suffix)
    title = scalars.annotation_property(F.concat(F.lit("quire"), suffix))
    marked = F.concat(F.lit("::error file="), scalars.annotation_property(F.col("path")), F.lit(",title="), title, F.lit("::"), scalars.annotation_data(message))
    return found.where("refused").select("path", (marked if annotated else plain).alias("line"))
