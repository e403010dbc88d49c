"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .abuse import KINDS, THRESHOLD, score_texts


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score, in all and by kind."""
    return score_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are abusive, hateful or sexually explicit."""
    return p10_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, how many are abusive, and the rate."""
    scores = p10_scores(spark, sf_dir).select("doc_id", (F.col("score") >= THRESHOLD).cast("int").alias("hit"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(scores, "doc_id")
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("hit").alias("abusive")).withColumn("rate", F.col("abusive") / F.col("documents"))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source with a score, and whether each score is the sum of its kinds."""
    scores = p10_scores(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(scores, "doc_id")
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.min(F.abs(total - F.col("score")) < 1e-9).alias("summed"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates, "p10_documents": p10_documents}
SQL = {"p10_documents": "SELECT source, count(*) AS documents, true AS summed FROM documents GROUP BY 1"}
