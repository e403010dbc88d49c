"""One object with the library's verbs over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import analytics, dedup, evaluate, hierarchy, language, lineage, quality, relational, retrieval
from .plans.p6 import graph
from .sources.tables import clean_id, latest, table


class Engine:
    """Reads ``name.parquet`` of a folder and answers with DataFrames; nothing runs until one is used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def sources(self, limit: int = 200, offset: int = 0) -> DataFrame:
        """A page of sources with their number of chunks."""
        n = self.table("chunks").select("id", "source_id").distinct().groupBy("source_id").agg(F.count("*").alias("chunks"))
        s = self.table("sources").dropDuplicates(["id"])
        return relational.page(s.join(n, F.col("source_id") == F.col("id"), "left").select("id", "title", "source_type", F.coalesce("chunks", F.lit(0)).alias("chunks")), ["id"], limit, offset)

    def source_chunks(self, source_id: int, limit: int = 200, offset: int = 0) -> DataFrame:
        return relational.page(self.table("chunks").where(F.col("source_id") == source_id).dropDuplicates(["id"]), ["chunk_index", "id"], limit, offset)

    def items(self) -> DataFrame:
        """Corpus items in their current version."""
        return latest(self.table("corpus_items").withColumn("document_id", clean_id("document_id")), "document_id")

    def candidates(self) -> DataFrame:
        """Catalogue candidates in their current version."""
        return latest(self.table("corpus_candidates").withColumn("candidate_id", clean_id("candidate_id")), "candidate_id")

    def stats(self) -> DataFrame:
        """Rows of each table."""
        out = None
        for name in ("sources", "chunks", "corpus_candidates", "corpus_items", "cycles", "documents"):
            one = self.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def retrieve(self, query: str, limit: int = 10) -> DataFrame:
        """The documents that answer a query best by their words."""
        q = self.spark.range(1).select(F.lit(0).alias("query_id"), F.explode(X.terms(F.lit(query))).alias("term"))
        return retrieval.bm25(q, self.table("documents"), "doc_id", "text", limit)

    def retrieve_near(self, vec_id: int, limit: int = 10) -> DataFrame:
        v = self.table("embeddings")
        q = v.where(F.col("vec_id") == vec_id).select(F.col("vec_id").alias("query_id"), "embedding")
        return retrieval.knn(q, v, "vec_id", "embedding", limit)

    def canon(self, limit: int = 50) -> DataFrame:
        """The newest accepted cycles."""
        c = self.table("cycles").where("verdict = 'CANON' and dry_run = 0").dropDuplicates(["id"])
        return c.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

    def canon_as_of(self, cutoff: str) -> DataFrame:
        """Each cycle's verdict among those known at a time."""
        states = self.table("cycles").select("id", "verdict", "final_score", "created_at").distinct()
        return relational.as_of(states, "id", "created_at", "created_at", F.lit(cutoff).cast("timestamp_ntz"))

    def evaluate_fragments(self) -> DataFrame:
        return evaluate.evaluated_cycles(self.table("cycles"))

    def lineage(self, most: int = 3) -> DataFrame:
        """Ancestors of every record within some steps."""
        links, nodes = graph(self.spark, self.folder)
        return lineage.ancestors(links, nodes, most)

    def hierarchy(self) -> DataFrame:
        return hierarchy.hierarchy(graph(self.spark, self.folder)[0])

    def events(self, since: int = 0, limit: int = 200) -> DataFrame:
        return self.table("events").where(F.col("event_id") > since).orderBy("event_id").limit(limit)

    def semantic_neighbors(self) -> DataFrame:
        """Subjects that stand together."""
        return analytics.cooccurrence(self.table("corpus_items").select("document_id", F.explode("subjects").alias("s")), "s", "document_id")

    def quality(self) -> DataFrame:
        return quality.score(quality.components(self.table("documents"), "doc_id", "text", "lang", "doc_type"))

    def languages(self) -> DataFrame:
        return language.by_function_words(self.table("documents"), "doc_id", "text")

    def duplicates(self) -> DataFrame:
        """Each document's class of copies, and its links to similar classes."""
        return dedup.links_per_row(*dedup.near_pairs(self.table("documents"), "doc_id", "text"), "doc_id")

    def schools(self, k: int = 8) -> DataFrame:
        return analytics.kmeans(self.table("embeddings"), "vec_id", "embedding", k)
