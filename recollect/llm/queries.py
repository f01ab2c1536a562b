"""Queries of the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import chat_format, embedding_dedup, jaccard_join, licenses, mixing, packing, pii, quality_model, quality_rules, warc
from recollect.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *quality_rules.METRICS, "failed", "keep")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymise(docs.select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = warc.archive(warc.records(table(spark, sf_dir, "pages")))
    return warc.reconstruct(headers, payloads).withColumn("record", F.col("record").cast("string"))  # pages are text


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_packing": op2_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_licenses": op5_licenses,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_quality_model": op8_quality_model,
    "op9_chat_format": op9_chat_format,
    "op10_mixing": op10_mixing,
}
SQL: dict[str, str] = {
    "op3_jaccard_join": jaccard_join.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op7_warc": warc.SQL,
    "op9_chat_format": chat_format.SQL,
}
