"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .inputs import providers
from .labels import label_language
from .q_langid import p1_languages
from .tokens import token_counts

VOCAB = "byte_bpe_50k"


def text_tokens(spark: SparkSession, sf_dir: str, vocab: str = VOCAB) -> DataFrame:
    """``(kind, id, group, n_tokens)``: each text once; ``group`` is the source's id or the document's slice."""
    chunk = table(spark, sf_dir, "chunks").select("id", F.col("source_id").cast("string").alias("grp"), "content")
    chunk = token_counts(chunk, "id", "content", vocab)
    # only the figures of repeated rows are shuffled, not their texts
    chunk = chunk.groupBy("id").agg(F.max(F.struct("grp", "n_tokens")).alias("r")).select(F.lit("chunk").alias("kind"), "id", "r.*")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.to_json(F.struct("domain", "source", label_language(F.col("lang")).alias("lang"))).alias("grp"), "text")
    docs = token_counts(docs, "id", "text", vocab).select(F.lit("document").alias("kind"), "id", "grp", "n_tokens")
    return chunk.unionByName(docs)


def p5_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tokens by slice, by each of its parts and in all.

    ``slice`` is the source's type or the document's domain, ``provider`` the
    catalogue provider or the document's source, ``language`` what the label
    names. ``level`` says by which of them a row is summed; the others are
    null in it. A missing value shows as ``none``.
    """
    texts = text_tokens(spark, sf_dir).groupBy("kind", "grp").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
    own = table(spark, sf_dir, "sources").groupBy(F.col("id").alias("text_id")).agg(F.max(F.struct("source_type", "language")).alias("s"))
    chunk = (
        texts.where("kind = 'chunk'").withColumn("text_id", F.col("grp").cast("long")).join(own, "text_id", "left").join(providers(spark, sf_dir), "text_id", "left")
        .select("kind", F.col("s.source_type").alias("slice"), "provider", label_language(F.col("s.language")).alias("language"), "texts", "tokens")
    )
    named = F.from_json("grp", "domain string, source string, lang string")
    docs = texts.where("kind = 'document'").withColumn("g", named).select("kind", F.col("g.domain").alias("slice"), F.col("g.source").alias("provider"), F.col("g.lang").alias("language"), "texts", "tokens")
    cells = chunk.unionByName(docs).fillna("none", ["slice", "provider", "language"]).groupBy("kind", "slice", "provider", "language").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    cells.createOrReplaceTempView("tessera_budget_cells")
    return spark.sql(
        """SELECT kind, CASE grouping_id() WHEN 0 THEN 'cell' WHEN 3 THEN 'slice' WHEN 5 THEN 'provider' WHEN 6 THEN 'language' ELSE 'all' END AS level,
                  slice, provider, language, CAST(sum(texts) AS BIGINT) AS texts, CAST(sum(tokens) AS BIGINT) AS tokens
           FROM tessera_budget_cells GROUP BY kind, slice, provider, language
           GROUPING SETS ((kind, slice, provider, language), (kind, slice), (kind, provider), (kind, language), (kind))"""
    )


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk and document with its size in tokens."""
    return text_tokens(spark, sf_dir).select("kind", "id", "n_tokens")


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and tokens by the language that problem 1 finds, whatever the label says; ``none`` where it finds none.

    A chunk counts under its source's language.
    """
    texts = text_tokens(spark, sf_dir).groupBy("kind", "grp", F.when(F.col("kind") == "document", F.col("id")).alias("doc")).agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
    named = texts.select(F.when(F.col("kind") == "chunk", "source").otherwise("document").alias("kind"), F.coalesce(F.col("doc").cast("string"), F.col("grp")).alias("record_id"), "texts", "tokens")
    found = p1_languages(spark, sf_dir).where("kind in ('source', 'document')").groupBy("kind", "record_id").agg(F.max("language").alias("language"))
    return named.join(found, ["kind", "record_id"], "left").groupBy("kind", F.coalesce("language", F.lit("none")).alias("language")).agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))


def p5_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each level of the budget holds, and whether all levels hold the same tokens."""
    b = p5_budget(spark, sf_dir).groupBy("kind", "level").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    whole = b.where("level = 'all'").select("kind", F.col("tokens").alias("t"))
    return b.join(whole, "kind").select("kind", "level", "texts", (F.col("tokens") == F.col("t")).alias("same_tokens"))


QUERIES = {"p5_budget": p5_budget, "p5_texts": p5_texts, "p5_languages": p5_languages, "p5_sums": p5_sums}
SQL = {
    "p5_sums": """WITH n AS (SELECT 'chunk' kind, count(DISTINCT id) + max(CASE WHEN id IS NULL THEN 1 ELSE 0 END) n FROM chunks UNION ALL SELECT 'document', count(*) FROM documents)
SELECT kind, unnest(['cell', 'slice', 'provider', 'language', 'all']) AS level, n AS texts, true AS same_tokens FROM n WHERE n > 0"""
}
