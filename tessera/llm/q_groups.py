"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import clean_id, latest, table
from .groups import components, star

#: What names a work; fixed format. Blanks, "n/a" and a bare "work-" name none.
WORK = r"^work-[0-9a-f]{16}$"


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(links, items)``: links (``a``, ``b``) between known items by all three signs."""
    raw = table(spark, sf_dir, "corpus_items").select(clean_id("document_id").alias("id"), clean_id("duplicate_of").alias("dup"), clean_id("canonical_work_id").alias("work"), "updated_at")
    items = materialize(latest(raw, "id").select("id", "dup", "work"), "group-items")
    known = items.select("id")
    dup = items.where("dup is not null").select(F.col("id").alias("a"), F.col("dup").alias("b")).join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    work = star(items.where(F.col("work").rlike(WORK)).select("work", "id"), "work", "id")
    members = table(spark, sf_dir, "corpus_duplicate_members").select(clean_id("cluster_id").alias("cluster"), clean_id("document_id").alias("id")).where("cluster is not null").distinct()
    cluster = star(members.join(known, "id", "left_semi"), "cluster", "id")
    return dup.select("a", "b").unionByName(work).unionByName(cluster), known


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of a group of two or more, with the group's smallest item."""
    pairs, _ = links(spark, sf_dir)
    return components(pairs).select(F.col("p").alias("group_id"), F.col("v").alias("document_id"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with its group; an item linked to none is its own."""
    pairs, items = links(spark, sf_dir)
    return items.join(components(pairs).withColumnRenamed("v", "id"), "id", "left").select(F.coalesce("p", "id").alias("group_id"), F.col("id").alias("document_id"))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

_SQL = """WITH RECURSIVE
 it AS (SELECT id, dup, work FROM (SELECT lower(trim(document_id)) id, lower(trim(duplicate_of)) dup, lower(trim(canonical_work_id)) work,
          row_number() OVER (PARTITION BY lower(trim(document_id)) ORDER BY updated_at DESC NULLS LAST) r FROM corpus_items) WHERE r = 1),
 hub AS (SELECT 'i' || id k, id FROM it
   UNION SELECT 'i' || d.dup, d.id FROM it d JOIN it x ON x.id = d.dup
   UNION SELECT 'w' || work, id FROM it WHERE regexp_full_match(work, 'work-[0-9a-f]{16}')
   UNION SELECT 'c' || lower(trim(m.cluster_id)), i.id FROM corpus_duplicate_members m JOIN it i ON i.id = lower(trim(m.document_id))),
 e AS (SELECT DISTINCT x.id a, y.id b FROM hub x JOIN hub y ON x.k = y.k),
 r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
 g AS (SELECT a id, min(b) grp, count(*) n FROM r GROUP BY a)"""
SQL = {
    "p3_found": _SQL + " SELECT grp AS group_id, id AS document_id FROM g WHERE n > 1",
    "p3_groups": _SQL + " SELECT grp AS group_id, id AS document_id FROM g",
}
