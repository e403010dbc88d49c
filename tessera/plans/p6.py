"""Queries of problem 6: the trees of corpus items and the ancestry of canon cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import LOOP, clean_links, descendants, hierarchy, paths
from ..session import materialize
from ..sources.tables import clean_id, latest, table

#: The kind stands before the id within a node's name, so that both kinds go through one run.
_SEP = ":"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(links, nodes)`` of both kinds, each node named ``kind:id``."""
    items = table(spark, sf_dir, "corpus_items").select(clean_id("document_id").alias("id"), clean_id("parent_document_id").alias("up"), "updated_at")
    items = latest(items, "id").select("id", F.array_compact(F.array("up")).alias("ups"))
    cycles = table(spark, sf_dir, "cycles").select(F.col("id").cast("string").alias("id"), F.col("parent_cycle_ids").cast("array<string>").alias("ups"), "created_at")
    cycles = latest(cycles, "id", "created_at")
    named = [(df, F.lit(kind + _SEP)) for df, kind in ((items, "item"), (cycles.select("id", "ups"), "canon"))]
    links = None
    nodes = None
    for df, kind in named:
        own = df.select(F.concat(kind, F.col("id")).alias("node"))
        up = df.select(F.concat(kind, F.col("id")).alias("child"), F.explode("ups").alias("p")).select("child", F.concat(kind, F.col("p")).alias("parent"))
        nodes = own if nodes is None else nodes.unionByName(own)
        links = up if links is None else links.unionByName(up)
    return clean_links(links, nodes), nodes


def _plain(node: str) -> tuple:
    return F.substring_index(node, _SEP, 1).alias("kind"), F.expr(f"substring({node}, instr({node}, '{_SEP}') + 1)")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that has a parent, with each root above it; ``loop`` where a way upwards runs into a circle."""
    links, _ = graph(spark, sf_dir)
    facts = hierarchy(links)
    # a root's only row is itself with no hop; every other node of the links has a parent
    below = facts.where("root is null or node != root")
    kind, node = _plain("node")
    return below.select(kind, node.alias("node_id"), F.coalesce(_plain("root")[1], F.lit(LOOP)).alias("root_id"))


def p6_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its path and depth from each root and how many records are below it.

    Records without parents and children stand for themselves. Where circles
    are above a record it has a row with ``root_id`` ``loop``, without path and
    depth.
    """
    links, nodes = graph(spark, sf_dir)
    links = materialize(links, "hierarchy-links")
    below = descendants(links).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("below"))
    found = paths(hierarchy(links)).withColumn("linked", F.lit(True))
    facts = nodes.distinct().join(found, "node", "left").join(below, "node", "left")
    alone = F.col("linked").isNull()
    kind, node = _plain("node")
    return facts.select(
        kind,
        node.alias("node_id"),
        F.when(alone, node).otherwise(F.coalesce(_plain("root")[1], F.lit(LOOP))).alias("root_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("hops")).cast("long").alias("depth"),
        F.when(alone, node).otherwise(F.expr("array_join(transform(path, x -> substring(x, instr(x, ':') + 1)), '/')")).alias("path"),
        F.coalesce("below", F.lit(0)).alias("below"),
    )


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with each record below it, one row a pair."""
    links, _ = graph(spark, sf_dir)
    kind, node = _plain("ancestor")
    return descendants(links).select(kind, node.alias("node_id"), _plain("node")[1].alias("descendant_id"))


def p6_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that has a parent, with each root above it and how many hops the shortest way to it has."""
    links, _ = graph(spark, sf_dir)
    kind, node = _plain("node")
    return hierarchy(links).where("hops > 0").select(kind, node.alias("node_id"), _plain("root")[1].alias("root_id"), F.col("hops").alias("depth"))


QUERIES = {"p6_found": p6_found, "p6_depths": p6_depths, "p6_hierarchy": p6_hierarchy, "p6_descendants": p6_descendants}

_GRAPH = """WITH RECURSIVE
 it AS (SELECT id, up FROM (SELECT lower(trim(document_id)) id, nullif(lower(trim(parent_document_id)), '') up,
          row_number() OVER (PARTITION BY lower(trim(document_id)) ORDER BY updated_at DESC NULLS LAST, nullif(lower(trim(parent_document_id)), '') DESC NULLS LAST) r
        FROM corpus_items WHERE nullif(trim(document_id), '') IS NOT NULL) WHERE r = 1),
 cy AS (SELECT DISTINCT id, parent_cycle_ids ups FROM cycles),
 nodes AS (SELECT 'item' kind, id FROM it UNION SELECT 'canon', id::VARCHAR FROM cy),
 raw AS (SELECT 'item' kind, id child, up parent FROM it WHERE up IS NOT NULL
         UNION SELECT 'canon', id::VARCHAR, unnest(ups)::VARCHAR FROM cy),
 links AS (SELECT DISTINCT r.* FROM raw r JOIN nodes n ON n.kind = r.kind AND n.id = r.parent),
 reach AS (SELECT kind, child, parent FROM links
           UNION SELECT r.kind, r.child, l.parent FROM reach r JOIN links l ON l.kind = r.kind AND l.child = r.parent)"""

SQL = {
    "p6_found": _GRAPH
    + """, tops AS (SELECT kind, id FROM nodes EXCEPT SELECT kind, child FROM links),
 ring AS (SELECT kind, child id FROM reach WHERE child = parent)
SELECT r.kind, r.child AS node_id, r.parent AS root_id FROM reach r JOIN tops t ON t.kind = r.kind AND t.id = r.parent
UNION SELECT r.kind, r.child, 'loop' FROM reach r JOIN ring g ON g.kind = r.kind AND g.id = r.parent""",
    "p6_depths": _GRAPH
    + """, dist AS (SELECT kind, child id, parent up, 1 d FROM links UNION SELECT s.kind, s.id, l.parent, s.d + 1 FROM dist s JOIN links l ON l.kind = s.kind AND l.child = s.up WHERE s.d < 400),
 tops AS (SELECT kind, id FROM nodes EXCEPT SELECT kind, child FROM links)
SELECT s.kind, s.id AS node_id, s.up AS root_id, min(s.d)::BIGINT AS depth FROM dist s JOIN tops t ON t.kind = s.kind AND t.id = s.up GROUP BY ALL""",
    "p6_descendants": _GRAPH + " SELECT DISTINCT kind, parent AS node_id, child AS descendant_id FROM reach",
}
