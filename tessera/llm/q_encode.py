"""Query of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .encode import encode_texts


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids; an empty list for an empty text and for none."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
SQL: dict = {}
