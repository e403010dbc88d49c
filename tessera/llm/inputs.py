"""The tables as the queries of this folder read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import clean_id, latest, table


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Chunks ``(id, text_id, content)``, exact repeats of a row once.

    Repeats share their id, so one row an id is kept: whichever is greatest.
    Rows without an id can't be told to be repeats and all stay.
    """
    cols = ["text_id", "content", *more]
    raw = table(spark, sf_dir, "chunks").select("id", F.col("source_id").alias("text_id"), "content", *more)
    # repeats are few: written first, so that the planner knows their size and need not shuffle the texts of the others
    twice = materialize(raw.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "chunk-repeats")
    again = raw.join(twice, "id", "left_semi").groupBy("id").agg(F.max(F.struct(*cols)).alias("r")).select("id", "r.*")
    return raw.join(twice, "id", "left_anti").unionByName(again)


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(text_id, provider)``: the catalogue provider of each text that has an item."""
    items = table(spark, sf_dir, "corpus_items").select(clean_id("document_id").alias("document_id"), "source_id", "source_row_id", "updated_at")
    items = latest(items, "document_id")
    return items.where("source_row_id is not null and source_id is not null").select(F.col("source_row_id").alias("text_id"), F.col("source_id").alias("provider")).distinct()
