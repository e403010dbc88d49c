"""Ancestors within a number of steps, edges from facts, reports over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(links: DataFrame, starts: DataFrame, most: int = 3) -> DataFrame:
    """``(node, ancestor, hop)``: who stands above each start within ``most`` steps, by the least number of them.

    One join a step; a pair that is known isn't followed again, so circles end.
    """
    up = links.select(F.col("child").alias("at"), F.col("parent").alias("to")).distinct()
    seen = new = starts.select(F.col("node"), F.col("node").alias("ancestor"), F.lit(0).alias("hop"))
    for hop in range(1, most + 1):
        step = new.select("node", F.col("ancestor").alias("at")).join(up, "at").select("node", F.col("to").alias("ancestor")).distinct()
        new = step.join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(new)
    return seen.where("hop > 0")


def roots(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes without a known parent."""
    return nodes.distinct().join(links.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def edges(*facts: tuple[DataFrame, str, str, str, str, str]) -> DataFrame:
    """One edge table ``(src_type, src_id, tgt_type, tgt_id, relation)`` of several tables of facts, each edge once.

    A fact is (table, source type, source column, target type, target column, relation).
    """
    parts = [df.select(F.lit(st).alias("src_type"), F.col(s).cast("string").alias("src_id"), F.lit(tt).alias("tgt_type"), F.col(t).cast("string").alias("tgt_id"), F.lit(rel).alias("relation")).where("src_id is not null and tgt_id is not null") for df, st, s, tt, t, rel in facts]
    return reduce(DataFrame.unionByName, parts).distinct()


def supply_chain(expected: DataFrame, actual: DataFrame, keys: list[str], group: str) -> DataFrame:
    """``(group, expected, found, completeness, missing)``: how much of what each should have is there; 1 for nothing expected."""
    have = actual.select(*keys).distinct().withColumn("_there", F.lit(1))
    both = expected.select(*keys).distinct().join(have, keys, "left")
    what = F.concat_ws(":", *[k for k in keys if k != group])
    return both.groupBy(group).agg(
        F.count("*").alias("expected"), F.count("_there").alias("found"), (F.count("_there") / F.count("*")).alias("completeness"),
        F.array_sort(F.collect_set(F.when(F.col("_there").isNull(), what))).alias("missing"),
    )


def causation(events: DataFrame, key: str, order: str, event_id: str) -> DataFrame:
    """``events`` with ``causation_id``: the event before it in its chain."""
    from pyspark.sql.window import Window

    return events.withColumn("causation_id", F.lag(event_id).over(Window.partitionBy(key).orderBy(order)))


def drift(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, before, after)`` of the fields that differ, a null differing from any value."""
    left = a.select(key, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    right = b.select(key, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    pairs = ", ".join(f"'{f}', a_{f}, b_{f}" for f in fields)
    return left.join(right, key).selectExpr(key, f"stack({len(fields)}, {pairs}) AS (field, before, after)").where("NOT (before <=> after)")


def same_partition(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(same, only_a, only_b)``: whether two groupings (``grp``, ``member``) are the same sets of members."""
    fold = lambda df: df.distinct().groupBy("grp").agg(F.min("member").alias("lo"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("member")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "member"), F.lit(1 << 40))).alias("s")).select("lo", "n", "x", "s")
    fa, fb = fold(a), fold(b)
    one = fa.exceptAll(fb).agg(F.count("*").alias("only_a")).crossJoin(fb.exceptAll(fa).agg(F.count("*").alias("only_b")))
    return one.select(((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("same"), "only_a", "only_b")


def gaps(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(relation, edges, gaps)``: how many edges each relation has and how many of them end at nothing known; ``nodes`` has ``tgt_type`` and ``tgt_id``."""
    known = nodes.distinct().withColumn("_there", F.lit(1))
    return edges_.join(known, ["tgt_type", "tgt_id"], "left").groupBy("relation").agg(F.count("*").alias("edges"), F.count_if(F.col("_there").isNull()).alias("gaps"))


def adjacent(edges_: DataFrame, asked: DataFrame) -> DataFrame:
    """``(direction, node, other)``: the edges out of and into each asked node."""
    out = edges_.select(F.lit("out").alias("direction"), F.col("src_id").alias("node"), F.col("tgt_id").alias("other"))
    into = edges_.select(F.lit("in").alias("direction"), F.col("tgt_id").alias("node"), F.col("src_id").alias("other"))
    return out.unionByName(into).join(asked.select("node").distinct(), "node", "left_semi").select("direction", "node", "other").distinct()
