"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token shards.

Each stage works on all that the one before it kept, and is written before the
next one reads it. All but the last return the columns of documents, further
columns among them whatever their names, and take null keys, repeated rows, null,
empty and very long texts, and tables without rows; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, decontaminate, mixing, neardup, quality, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects.

    Null, empty and short texts go; repeated rows share one fate; without labels the
    base rules alone decide.
    """
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id: five-word shingles, similarity 0.8.

    Null and wordless texts are like nothing and stay; of rows alike in id and text
    one stays; null is the largest id.
    """
    return neardup.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay, repeated rows share one fate; an empty benchmark, or
    one of null items, leaves all.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight draws them.

    Null is a source of its own; texts without a word have no weight and share the
    fate of their block; repeated rows are drawn alike.
    """
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and check sum of each document's ids in the shards.

    Null texts are the end id alone, null ids come first, repeated rows follow on each
    other.
    """
    return tokens.encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("token shards", token_shards),
]

#: The learned list, the drawn copies and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored as Parquet and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, f"pipeline-{i}")
    return docs
