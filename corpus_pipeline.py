"""A corpus cleaned, mixed and tokenized in five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.decontaminate import drop_contaminated
from framewright.llm.language_id import keep_known_language
from framewright.llm.mixing import mixed_texts
from framewright.llm.ngram_join import keep_one_of_each
from framewright.llm.tables import shared_dir, table
from framewright.llm.token_store import token_store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language can be told; null, empty and letterless texts go. Repeated rows are judged alike; an empty table stays empty."""
    return keep_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id; see keep_one_of_each for repeated and null ids."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item; null and empty texts stay, each row is judged on its own text."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a text in part, whole or twice, as rows with the columns of docs; texts without words are no part of it. Null is a source."""
    return mixed_texts(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row in the order of doc_id (nulls first), then text; a null or empty text is its end id alone."""
    return token_store(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Training profiles, hashing and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
