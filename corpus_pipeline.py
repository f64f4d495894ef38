"""A corpus pipeline of five stages over `documents`: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a DataFrame; every one but
the last returns the columns of `documents` and of any others that the rows have, whatever their names.

In every stage a null text counts as empty: quality rules drop it (it has fewer than 10 words). A null doc_id sorts last among
near duplicates, a null source is a source of its own, repeated rows are one document from the second stage on, ties go to the least doc_id
(then key), an empty table stays empty, and texts of any length are processed whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import jaccard_join, mixing, packing, quality, secrets
from lexquarry.llm.common import fresh, hashed_id, kept_table

#: No SQL: the quality verdict needs hashed multinomials, packing a tokenizer. `tests/llm/test_pipeline.py` has a brute force of every stage.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link, that with the least doc_id stays."""
    rows = jaccard_join.link_classes(docs)
    # a document without shingles is a group of its own
    first = rows.groupBy("component", F.when(F.col("component").isNull(), F.col("key")).alias("alone")).agg(F.min(F.struct("doc_id", "key")).alias("first"))
    (key,) = fresh(docs, "key")
    keep = first.select(F.col("first.key").alias(key))
    # rows alike in doc_id and text are one document
    once = docs.withColumn(key, hashed_id()).join(keep, key, "left_semi").dropDuplicates([key])
    return once.select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return with_chars(secrets.redact(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, with the words that the pass takes of it."""
    return with_chars(mixing.mixed_documents(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


def with_chars(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept_table(docs)
    return docs
