"""Readers of the Parquet tables and the rule that picks a record's current version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_id(col: Column | str) -> Column:
    """An id as ids are compared: trimmed, without case; blank becomes null.

    Every kind of white space is trimmed, not only the blank.
    """
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(c != "", c)


def latest(df: DataFrame, key: str, order: str = "updated_at", keep: list[str] | None = None) -> DataFrame:
    """One row for each ``key``: the one with the greatest ``order``.

    An aggregate with ``max_by`` and not a window, so that versions are
    combined before the shuffle and a key with very many versions costs no
    more than another. Rows with a null key are dropped; a null ``order``
    loses to any other; among equal ones the greatest row counts, which makes
    exact repeats and ties give the same result on every run.
    """
    cols = [c for c in (keep or df.columns) if c != key]
    row = F.struct(*[F.col(c) for c in cols])
    # arrays and strings compare, so the row itself can break ties
    best = F.max_by(row, F.struct(F.col(order).isNotNull(), F.col(order), row))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_r")).select(key, "_r.*")
