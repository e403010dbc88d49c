"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .pack import cut_oversized, pack
from .tokens import token_counts_by


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size for each window, its source and the mark that copies share."""
    windows = table(spark, sf_dir, "context_windows").dropDuplicates(["window_id"])
    vocabs = sorted(r[0] for r in windows.select("tokenizer").distinct().collect())  # one row a vocabulary
    mark = F.lower(F.regexp_replace("text", r"\s+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.length(F.trim("text")) > 0, F.xxhash64(mark)).alias("cluster"), "text")
    docs = token_counts_by(docs, "text", {f"n_{v}": v for v in vocabs})
    sizes = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"n_{v}").alias("n_tokens")) for v in vocabs]))
    long = docs.select("doc_id", "source", "cluster", sizes.alias("s")).select("doc_id", "source", "cluster", "s.*")
    return long.join(F.broadcast(windows.select("window_id", "tokenizer", F.col("capacity_tokens").alias("capacity"))), "tokenizer")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, or places if it exceeds a container, for each window."""
    return pack(cut_oversized(sized(spark, sf_dir)))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the unused share of each window, with the fewest containers there could be."""
    boxes = p9_containers(spark, sf_dir).groupBy("window_id", "container").agg(F.sum("tokens").alias("tokens"))
    windows = table(spark, sf_dir, "context_windows").select("window_id", "capacity_tokens").distinct()
    out = boxes.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).join(F.broadcast(windows), "window_id")
    return out.select("window_id", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused"))


def p9_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window: how many documents have a place, whether every one has all its pieces, and whether any container holds too much."""
    placed = p9_containers(spark, sf_dir)
    windows = table(spark, sf_dir, "context_windows").select("window_id", "capacity_tokens").distinct()
    full = placed.groupBy("window_id", "container").agg(F.sum("tokens").alias("t")).join(F.broadcast(windows), "window_id").groupBy("window_id").agg(F.max(F.col("t") > F.col("capacity_tokens")).alias("over"))
    each = placed.groupBy("window_id", "doc_id").agg(F.count("*").alias("n"), F.max("piece_no").alias("last"), F.countDistinct("piece_no").alias("d"))
    docs = each.groupBy("window_id").agg(F.count("*").alias("documents"), F.min((F.col("n") == F.col("last") + 1) & (F.col("n") == F.col("d"))).alias("whole"))
    return docs.join(full, "window_id").select("window_id", "documents", "whole", "over")


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill, "p9_places": p9_places}
SQL = {"p9_places": "SELECT DISTINCT window_id, (SELECT count(*) FROM documents) AS documents, true AS whole, false AS over FROM context_windows"}
