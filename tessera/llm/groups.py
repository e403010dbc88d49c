"""Problem 3: consolidating pairwise matches into groups, over a two-dimensional grid.

Vertices are hashed into blocks, and a link goes to the cell of the grid that
its two blocks name. Every cell runs union-find over its own links and offers
each of its vertices a representative; a vertex takes the least of those that
its row and its column offer as its parent. Links are then rewritten to the
parents and the next round begins, until no link joins two different parents.

The grid has as many cells as keep a cell's links within the memory of a task,
and never fewer than two rows and columns, so that small tables go the same way
as large ones. Whatever a vertex's degree, one that a third of all links name is
spread over a whole row and column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CELL_LINKS = 40_000
#: Rows of one key that go to one task of a join; a key with more is spread over as many as it needs.
KEY_ROWS = 100_000


def union_find(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least member of each vertex's set; vertices are numbers below ``size``, the smaller the sooner."""
    parent = list(range(size))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    return np.fromiter((find(x) for x in range(size)), dtype=np.int64, count=size)


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    names, codes = np.unique(np.concatenate([pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)]), return_inverse=True)
    n = len(pdf)
    least = union_find(codes[:n], codes[n:], len(names))
    return pd.DataFrame({"v": names, "p": names[least]})


def _in_cells(links: DataFrame, blocks: int) -> DataFrame:
    """``(v, p)``: what each cell offers its vertices."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    # the pair is unordered, so that half the grid will do
    cell = links.withColumn("x", F.least(block("a"), block("b"))).withColumn("y", F.greatest(block("a"), block("b")))
    return cell.groupBy("x", "y").applyInPandas(lambda pdf: _cell(pdf[["a", "b"]]), "v string, p string")


def spread_join(df: DataFrame, side: DataFrame, key: str, how: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """``df`` joined to ``side``, which has each ``key`` at most once, with hot keys spread by how many rows they have.

    The table of hot keys has at most one row for every ``key_rows`` rows of
    ``df``, so that it can be sent to all tasks.
    """
    hot = F.broadcast(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > key_rows).select(key, F.ceil(F.col("_n") / key_rows).cast("int").alias("_k")))
    many = F.coalesce("_k", F.lit(1))
    left = df.join(hot, key, "left").withColumn("_s", F.pmod(F.xxhash64(*df.columns), many).cast("int")).drop("_k")
    right = side.join(hot, key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), many - 1))).drop("_k")
    return left.join(right, [key, "_s"], how).drop("_s")


def _renamed(df: DataFrame, col: str, parents: DataFrame) -> DataFrame:
    """``df`` with ``col`` replaced by its parent, if it has one."""
    out = spread_join(df, parents.select(F.col("v").alias(col), F.col("p").alias("_p")), col, "left")
    return out.withColumn(col, F.coalesce("_p", col)).select(*df.columns)


def components(links: DataFrame, cell_links: int = CELL_LINKS) -> DataFrame:
    """``(v, p)``: every vertex of ``links`` (``a``, ``b``) with the least vertex it is linked to.

    Links to oneself and null ends are ignored; repeated ones count once. An
    empty table gives an empty result.
    """
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    rest = materialize(links.where("a is not null and b is not null and a != b").select(*ends("a", "b")).distinct(), "grid-links")
    left, rounds = rest.count(), []
    while left:
        blocks = max(2, math.ceil(math.sqrt(2 * left / cell_links)))
        # the cells of a vertex's row and of its column: the least of what both offer is its parent
        offers = _in_cells(rest, blocks)
        parents = materialize(offers.groupBy("v").agg(F.min("p").alias("p")), "grid-parents")
        rounds.append(parents)
        moved = parents.where("v != p")
        rest = materialize(_renamed(_renamed(rest, "a", moved), "b", moved).where("a != b").select(*ends("a", "b")).distinct(), "grid-links")
        left = rest.count()
    if not rounds:
        return rest.select(F.col("a").alias("v"), F.col("b").alias("p"))
    found = rounds[0]
    for parents in rounds[1:]:
        found = materialize(_renamed(found, "p", parents.where("v != p")), "grid-found")
    return found


def star(df: DataFrame, key: str, member: str) -> DataFrame:
    """Links ``(a, b)`` that join all members of a key: each with the least of them, and no pair else."""
    low = df.groupBy(key).agg(F.min(member).alias("a"))
    return spread_join(df, low, key, "inner").select("a", F.col(member).alias("b")).where("a != b").distinct()
