"""Readers for the driver's Parquet tables and the stand-ins built on them.

Mapping (FIXTURES.md): ``documents`` -> corpus ``(docno, text)``;
``benchmark`` -> topics ``(qid, query)`` with the query cleaned as the
reference cleans questions; containment of a benchmark passage in a
document -> judgments; ``embeddings`` -> vectors; user turns of
``conversations`` -> questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean_question
from quarry.operators.judgments import containment_qrels


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the corpus shape ``(docno, text)``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("docno"), F.col("text"))


def raw_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text"))


def topics(spark: SparkSession, sf_dir: str, normalize: bool = True) -> DataFrame:
    """Topics ``(qid, query)``; the query is the cleaned passage text (G1)."""
    return raw_topics(spark, sf_dir).select(
        "qid", clean_question(F.col("text"), normalize=normalize).alias("query"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments ``(qid, docno, iteration, relevance)`` by containment."""
    return containment_qrels(corpus(spark, sf_dir), raw_topics(spark, sf_dir))


def document_splits(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three raw splits standing in for train / validation / test.

    Split ``pmod(doc_id, 3)``; ``para_id`` is the smallest ``doc_id`` with the
    same text, so exact copies share an id across splits (the reference's
    repeated paragraphs).  ``pos`` (file order) is ``doc_id``.
    """
    d = table(spark, sf_dir, "documents")
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    ids = d.groupBy(key.alias("k")).agg(F.min("doc_id").alias("first_id"))
    rec = (d.withColumn("k", key).join(ids, "k")
           .select(F.pmod("doc_id", F.lit(3)).alias("split"),
                   F.col("doc_id").alias("pos"),
                   F.col("first_id").cast("string").alias("para_id"),
                   F.col("text").alias("context"), F.col("text").alias("raw_ocr"),
                   F.col("source").alias("publication_date")))
    return [rec.filter(F.col("split") == i).drop("split") for i in range(3)]


def test_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-split records standing in for ``test.json``: one row per
    (passage, containing document) pair, with the passage as the question,
    its first sentence as ``answer`` and the passage as ``org_answer``."""
    b = table(spark, sf_dir, "benchmark")
    q = qrels(spark, sf_dir)
    return (q.join(b.withColumnRenamed("item_id", "qid"), "qid")
            .select(F.col("qid").cast("string").alias("query_id"),
                    F.col("docno").cast("string").alias("para_id"),
                    F.col("text").alias("question"),
                    F.split_part(F.col("text"), F.lit("."), F.lit(1)).alias("answer"),
                    F.col("text").alias("org_answer")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, embedding array<float>, label)``."""
    return table(spark, sf_dir, "embeddings")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as questions ``(qid, query)`` with
    ``qid = "<conv_id>:<turn>"`` (unique for any number of turns)."""
    c = table(spark, sf_dir, "conversations")
    return c.filter(F.col("role") == "user").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("query"))
