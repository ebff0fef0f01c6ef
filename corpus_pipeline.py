"""A training-data pipeline over ``documents``: five stages, each one operator of ``quire.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and rereads them.

Null ids and texts, repeated rows, empty and very long texts and empty tables are taken by every stage as
its operator's module states: rows without words fail the quality rules, rows with a null id are documents
of their own, lines and leaks are judged by text, and each row that is kept gets its own token ids.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.lines import strip_boilerplate
from quire.llm.minhash import near_dedup
from quire.llm.quality import quality_filter
from quire.llm.templates import decontaminate
from quire.llm.wordshuffle import encode_documents, id_digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the calibrated forest finds anomalous go."""
    return quality_filter(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; ``n_chars`` follows the text."""
    return strip_boilerplate(docs.select(*COLUMNS)).select(*COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return near_dedup(docs.select(*COLUMNS), percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, re-parameterised or not, go."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of these and of the bytes decoded from them."""
    vocabulary = public_tokenizers.path(VOCABULARY)

    digest = id_digests(vocabulary)

    def finish(ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
        count, own, back = digest(ids, ends)
        return [count, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))), own, back]

    rows = docs.select("doc_id", "lang", "source", "text")
    schema = "n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string"
    return encode_documents(rows, vocabulary, public_tokenizers.PATTERN, finish, schema)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the forest nor BPE. tests/llm holds lines, near-dedup, decontamination and BPE against
#: brute force on each stage's own input, and the first stage against verdicts that are so tested themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
