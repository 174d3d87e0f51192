"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver
or run() writes it as Parquet and reads it again as the next one's docs.
Every stage takes nulls in any column, empty and very long texts, repeated
rows and tables without rows; columns beside those of documents stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyscope.llm import jaccard, packing, quality, secrets, suffixes
from plyscope.llm.shared import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that aren't held out.

    Null and empty texts are scored like others.  Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar five-word shingles connect, the one with the smallest id stays.

    Documents are told by their ids; those without one stay, and so do null
    and empty texts, and all rows of an id that stays.
    """
    groups = jaccard.join(docs)
    own = F.max(F.col("doc_id") == F.col("component_id")).alias("own")
    behind = groups.where("doc_id is not null").groupBy("doc_id").agg(own).where("not own")
    return docs.join(behind, "doc_id", "left_anti").select(*docs.columns)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out.

    All rows stay; null texts stay null, and rows without an id or with
    equal ids lose nothing to each other.
    """
    return _measured(suffixes.dedupe(docs))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay, null and empty texts as they are."""
    return _measured(secrets.mask(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents with their ids and places.

    Null and empty texts are a closing token each; repeated rows are packed each.
    """
    return packing.pack(docs, with_ids=True)


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as the texts now are, where the column is there."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("passages", passages_once),
    ("secrets", secrets_masked),
    ("packing", packed),
]
#: The stages learn, search and pack; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to documents; each stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
