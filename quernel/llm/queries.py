"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import _spark, decontaminate, embedding_dedup, langid, licenses, mixing, ngram_join, quality, records, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find_repeats(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_shards(table(spark, sf_dir, "documents"), _spark.scratch(spark, "token-records"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents")).drop("text", "lang", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_token_records": op8_token_records,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op4_ngram_jaccard_join": ngram_join.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
}
