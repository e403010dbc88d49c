"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from ..sources.tables import table
from .inputs import chunks
from .split import LIMIT, OVERLAP, split_texts

#: Chunks numbered together; a source is numbered block by block, so no task gets more than a block.
_BLOCK = 4096


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk that the splitter had to cut."""
    raw = table(spark, sf_dir, "chunks").select("id", "content")
    return split_texts(raw, "id", "content").where("piece_no > 0").select("id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks cut to size: ``(id, source_id, chunk_index, char_start, char_end, content)``.

    ``chunk_index`` numbers the pieces of a source anew, in the order of the
    stored index and id. Offsets are those of the source's text, taken as its
    chunks one after another with a blank line between two; stored offsets are
    not used, as they may be missing or wrong.
    """
    own = chunks(spark, sf_dir, "chunk_index").select("id", F.col("text_id").alias("source_id"), F.coalesce("chunk_index", F.lit(0)).alias("ci"), "content").where("id is not null")
    # cut once for the numbers alone and again for the pieces: no text is written or moved in between
    sizes = split_texts(own, "id", "content", keep=("source_id", "ci")).groupBy("id", "source_id", "ci")
    facts = sizes.agg(F.count("*").alias("pieces"), F.max("end").alias("chars"))
    # prefix sums over blocks first, then within each: a source may hold a third of all chunks
    facts = materialize(facts.withColumn("block", F.floor(F.col("ci") / _BLOCK)), "split-facts")
    blocks = facts.groupBy("source_id", "block").agg(F.sum("pieces").alias("bp"), F.sum(F.col("chars") + 2).alias("bc"))
    prior = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source_id", "block", F.coalesce(F.sum("bp").over(prior), F.lit(0)).alias("p0"), F.coalesce(F.sum("bc").over(prior), F.lit(0)).alias("c0"))
    within = Window.partitionBy("source_id", "block").orderBy("ci", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = facts.join(blocks, ["source_id", "block"]).select(
        "id",
        "source_id",
        (F.col("p0") + F.coalesce(F.sum("pieces").over(within), F.lit(0))).alias("p"),
        (F.col("c0") + F.coalesce(F.sum(F.col("chars") + 2).over(within), F.lit(0))).alias("c"),
    )
    at = materialize(at, "split-offsets")
    cut = split_texts(own.join(at.select("id", "p", "c"), "id"), "id", "content", keep=("source_id", "p", "c"))
    return cut.select(
        "id", "source_id", (F.col("p") + F.col("piece_no")).alias("chunk_index"), (F.col("c") + F.col("start")).alias("char_start"), (F.col("c") + F.col("end")).alias("char_end"), "content"
    )


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text: its length, how much the pieces hold without what they repeat, the longest piece and the longest repeat."""
    cut = p2_pieces(spark, sf_dir)
    after = Window.partitionBy("id").orderBy("chunk_index")
    each = cut.select("id", "char_start", "char_end", F.coalesce(F.lag("char_end").over(after) - F.col("char_start"), F.lit(0)).alias("again"))
    size = F.col("char_end") - F.col("char_start")
    return each.groupBy("id").agg((F.max("char_end") - F.min("char_start")).alias("chars"), F.sum(size - F.col("again")).alias("held"), (F.max(size) <= LIMIT).alias("within"), (F.max("again") <= OVERLAP).alias("lapped"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_sizes": p2_sizes}
SQL = {
    "p2_found": "SELECT DISTINCT id FROM chunks WHERE length(replace(content, chr(13) || chr(10), chr(10))) > 1800",
    "p2_sizes": "SELECT id, n AS chars, n AS held, true AS within, true AS lapped FROM (SELECT DISTINCT id, length(replace(content, chr(13) || chr(10), chr(10))) n FROM chunks WHERE content IS NOT NULL AND id IS NOT NULL)",
}
