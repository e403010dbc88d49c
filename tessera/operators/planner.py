"""Which ways of search a query calls for, and which candidates a policy lets through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms

#: Ways that every query takes, and words that call for opposing evidence; fixed values.
BASE = ("LEXICAL", "SEMANTIC", "DOMAIN")
CUES = ("versus", "against", "contradiction", "oppose", "opposes", "conflict", "tension")


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """``(query_id, term)`` once each."""
    return queries.select("query_id", F.explode(terms(F.col(text))).alias("term")).distinct()


def detected_domains(asked: DataFrame, hints: DataFrame) -> DataFrame:
    """``(query_id, domain, position)``: domains one of whose hints is asked for. ``hints`` (``domain``, ``position``, ``term``) is declared."""
    return asked.join(F.broadcast(hints), "term").select("query_id", "domain", "position").distinct()


def strategies(asked: DataFrame, entities: DataFrame, motifs: DataFrame, oppositions: DataFrame, domains: DataFrame, as_of: bool = False) -> DataFrame:
    """``(query_id, strategy)``: the base ways, and those for which the tags, the cues or two opposed domains speak.

    ``entities`` and ``motifs`` have ``term`` in lower case; they are only
    asked whether a term is there, by semi-joins.
    """
    ids = asked.select("query_id").distinct()
    base = ids.select("query_id", F.explode(F.array(*[F.lit(x) for x in BASE])).alias("strategy"))
    by_tag = [asked.join(t.select("term").distinct(), "term", "left_semi").select("query_id", F.lit(n).alias("strategy")) for t, n in ((entities, "ENTITY"), (motifs, "MOTIF"))]
    cue = asked.where(F.col("term").isin(*CUES)).select("query_id", F.lit("CONTRADICTION").alias("strategy"))
    a, b = domains.select("query_id", F.col("domain").alias("a")), domains.select("query_id", F.col("domain").alias("b"))
    opposed = a.join(b, "query_id").join(F.broadcast(oppositions.select("a", "b")), ["a", "b"], "left_semi").select("query_id", F.lit("CONTRADICTION").alias("strategy"))
    out = base.unionByName(by_tag[0]).unionByName(by_tag[1]).unionByName(cue).unionByName(opposed)
    if as_of:
        out = out.unionByName(ids.select("query_id", F.lit("TEMPORAL").alias("strategy")))
    return out.distinct()


def merged_candidates(hits: DataFrame, key: str, k: int) -> DataFrame:
    """``(query_id, key, score, strategies)``: candidates of several ways, their scores summed, the ``k`` best of each query."""
    sums = hits.groupBy("query_id", key).agg(F.sum("score").alias("score"), F.array_sort(F.collect_set("strategy")).alias("strategies"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return sums.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def policy(ranked: DataFrame, key: str, group: str, score: str, most: int = 3, max_synthetic: float = 0.9) -> DataFrame:
    """``ranked`` with ``exclusion_reason``: too synthetic, or more than ``most`` of its group within the query; null for what stays.

    ``ranked`` has ``synthetic_ratio``; what is excluded for it takes no place of its group.
    """
    synthetic = F.coalesce("synthetic_ratio", F.lit(0.0)) > max_synthetic
    w = Window.partitionBy("query_id", group, synthetic).orderBy(F.desc(score), key)
    return ranked.withColumn("exclusion_reason", F.when(synthetic, "synthetic_ratio").when(F.row_number().over(w) > most, "max_per_source"))
