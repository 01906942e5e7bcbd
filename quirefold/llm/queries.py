"""Queries of the problems on texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import clean, encode, pack, pii
from quirefold.session import table as t


def p3_method(spark: SparkSession, d: str) -> DataFrame:
    """The site style tree over the whole table; p3_found can't come from it, as it prunes what p3_found must list."""
    return clean.prune_sites(t(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return clean.found_structure(t(spark, d, "documents"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_texts(t(spark, d, "documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(t(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode.token_counts(t(spark, d, "documents")).withColumnRenamed("doc_id", "key")
    return pack.pack_items(sizes).withColumnRenamed("key", "doc_id")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return pack.fill_report(p9_packed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(t(spark, d, "documents"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_texts(t(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_method, p3_found, p3_clean, p8_ids, p9_packed, p9_fill, p10_found, p10_redacted)}


def oracle_sql() -> dict[str, str]:
    """None of these is plain SQL: they are tested against the tokenizer itself, brute force and labelled fixtures."""
    return {}
