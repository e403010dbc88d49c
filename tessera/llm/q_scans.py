"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .inputs import chunks
from .scans import damage, repaired


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_id, head)``: what the title and the author of each source say."""
    return table(spark, sf_dir, "sources").groupBy(F.col("id").alias("source_id")).agg(F.max(F.concat_ws(" ", "title", "author")).alias("head"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with damage from scanning."""
    return damage(table(spark, sf_dir, "chunks").select("id", "source_id", "content"), "id", "content", "source_id", heads(spark, sf_dir))[0]


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk, the damaged ones repaired into continuous paragraphs."""
    return repaired(chunks(spark, sf_dir).select("id", F.col("text_id").alias("source_id"), "content"), "id", "content", "source_id", heads(spark, sf_dir))


QUERIES = {"p7_found": p7_found, "p7_repaired": p7_repaired}
SQL: dict = {}
