"""The corpus pipeline: documents without toxic ones, near copies and benchmark passages, mixed and written as token records.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written as
Parquet and read again. All but the last keep the columns of documents, whatever extra ones there are and whatever their
names. Stages lose nothing that they don't reject: repeated rows, null ids, null, empty and very long texts go through to the
end, and an empty table gives empty results. The mixture has all documents, and the records are in its order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import _spark, decontaminate, mixing, ngram_join, records, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (fitted on the labelled ones among docs) doesn't reject, all columns as they are. Null and empty texts
    stay; repeated rows stay or go together; without labels of both kinds all stay."""
    return toxicity.clean(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group connected by n-gram Jaccard similarity; rows of one doc_id are one document.
    Rows with a null doc_id, null texts or texts without words are in no group and stay, all columns as they are."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, all columns as they are; null and empty texts stay, and so does all if there are no items."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixture's order, all columns as they are; a null source is a source of its own."""
    return mixing.mix(docs)


def write_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token records to the shared folder, in the order of the files of docs (so of the mixture), and returns
    their offset index: one row for each document, null and empty texts being records without tokens."""
    shard = _spark.fresh(docs, "shard")
    return records.write_shards(records.in_file_order(docs, shard), _spark.scratch(spark, "token-records"), shard=shard)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_records", write_records),
]

#: No SQL expresses the classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = _spark.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            _spark.drop(spark, before)
        before = path
    return docs
