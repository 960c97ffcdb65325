"""A training-data pipeline over documents: quality, near duplicates, secrets, packing. Each stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import near_dup, packing, quality, secrets
from trajspark.llm.common import own_name, shared_folder, table
from trajspark.llm.queries import END_ID, GOOD, SEQ_LEN, tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    model, column = quality.fit(docs, table(spark, sf_dir, "labels")), own_name("quality")
    return quality.score(docs, model, column=column).where(F.col(column) >= GOOD).drop(column)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near_dup.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark; no document goes."""
    return secrets.redact(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; one row per piece."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), SEQ_LEN, END_ID, added_tokens=True)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("packing", packed)]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder as Parquet and reread as the next one's input."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
