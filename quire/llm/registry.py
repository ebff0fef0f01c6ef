"""Queries over the whole tables, one for each operator, with production parameters.

Each takes (spark, folder of the tables) and reads all rows. Nulls, repeated rows, ties and empty tables
give what its operator's module states, in the columns of the query. SQL for those that SQL can express
is in ``oracles``; SQL says nothing about placeholders, sketches, models and tokenizers, so op3, op5,
op7, op8, op9 and op10 are held against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.oracles import ORACLE_SQL as ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.urls import judge_urls

    return judge_urls(_read(spark, sf_dir, "pages")).drop("component")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"), 16)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.templates import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.chat import digest, examples

    columns = ["conv_id", "turn", "role", "text"]
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digest(examples(_read(spark, sf_dir, "conversations").select(*columns).union(extra)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.lines import strip_boilerplate

    return strip_boilerplate(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.lm import lm_scores

    return lm_scores(_read(spark, sf_dir, "documents"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.records import token_records

    return token_records(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import quality_verdicts

    return quality_verdicts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.wordshuffle import bpe_round_trip

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.divergence import source_divergence

    return source_divergence(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.vectorcodes import vector_codes

    return vector_codes(_read(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import simhash_duplicates

    return simhash_duplicates(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash": op6_minhash,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_records": op8_token_records,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash": op13_simhash,
}
