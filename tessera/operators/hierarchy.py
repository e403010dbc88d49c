"""Parent-child links of unknown depth: roots, depths, paths, descendants and circles.

Nodes are peeled from the bottom. A node without children left is a leaf: it
leaves the graph with its links. In reverse order of peeling, every node then
gets from its parents, which went after it, its roots, depth and the parent its
path goes through. What is never peeled holds a circle or stands above one.

Every round is a few joins over the links that are left, spread over the
cluster; no task gets more than its share. Peeling alone needs a round for each
level. So whenever a round takes less than ``SLOW`` of the links, runs of nodes
with one child and one parent each are contracted to one link: each node of a
run finds its end by pointers that leap four times as far each time. A chain of
a million links is gone after ten leaps.

A path is as long as its node is deep, so paths are put together only where
they are asked for, from the parents the nodes point to, again by leaps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Growing, materialize

LOOP = "loop"
#: Rounds of peeling that take a smaller share of the links left are followed by a contraction of runs.
SLOW = 0.25

_LINK = ("child", "parent", "w", "via")


def clean_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(child, parent)`` once each, both ends being known nodes; a link to oneself stays."""
    known = nodes.select(F.col("node").alias("parent")).distinct()
    return links.select("child", "parent").where("child is not null and parent is not null").distinct().join(known, "parent", "left_semi").select("child", "parent")


def _unary(rest: DataFrame) -> DataFrame:
    """``(v, t, d, via)``: nodes with one link down and one link up, to another node."""
    up = rest.groupBy(F.col("child").alias("v")).agg(F.count("*").alias("n"), F.first("parent").alias("t"), F.first("w").alias("d"), F.first("via").alias("via")).where("n = 1 and t != v").drop("n")
    down = rest.groupBy(F.col("parent").alias("v")).agg(F.count("*").alias("n")).where("n = 1").select("v")
    return up.join(down, "v", "left_semi")


def _leap(ptr: DataFrame) -> DataFrame:
    """Each pointer moved on up to four times as far; ``open`` where it still points to a node of a run."""
    out = ptr.select("v", "t", "d", "via")
    for i in range(3):
        step = ptr.select(F.col("v").alias("t"), F.col("t").alias("t2"), F.col("d").alias("d2"))
        out = out.join(step, "t", "left").select("v", F.coalesce("t2", "t").alias("t"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), "via", F.col("t2").isNotNull().alias("open"))
        if i < 2:
            out = out.drop("open")
    return out


def _contract(rest: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """``(gone, rings, rest)``: links of the nodes of runs to their runs' ends, links of circles that nothing hangs on, and the links left without both."""
    ptr, before = _unary(rest), None
    while True:
        ptr = materialize(_leap(ptr), "peel-runs")
        seen = ptr.agg(F.count("*"), F.count_if("open")).collect()[0]
        # a run's nodes come to its end one after another; those of a circle never do
        if not seen[1] or seen[1] == before:
            break
        before = seen[1]
    if not seen[0]:
        return None, None, rest
    gone = ptr.where("not open").select(F.col("v").alias("child"), F.col("t").alias("parent"), F.col("d").alias("w"), "via")
    end = ptr.select(F.col("v").alias("parent"), F.when(~F.col("open"), F.col("t")).alias("t"), "d")
    moved = rest.join(ptr.select(F.col("v").alias("child")), "child", "left_anti").join(end, "parent", "left")
    moved = moved.select("child", F.coalesce("t", "parent").alias("parent"), (F.col("w") + F.coalesce("d", F.lit(0))).alias("w"), "via")
    # two ways between the same nodes: the shorter one, then the one that sorts first
    moved = moved.groupBy("child", "parent").agg(F.min(F.struct("w", "via")).alias("l")).select("child", "parent", "l.*")
    rings = rest.join(ptr.where("open").select(F.col("v").alias("child")), "child", "left_semi") if seen[1] else None
    return gone if seen[0] > seen[1] else None, rings, materialize(moved, "peel-rest")


def peel_links(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stages of links ``(child, parent, w, via)`` whose child left the graph then, and the links never peeled.

    ``w`` is the number of hops a link stands for, ``via`` the true parent it
    begins with. The parents of a stage leave in a later one, or never.
    """
    rest = links.select("child", "parent", F.lit(1).cast("long").alias("w"), F.col("parent").alias("via"))
    stages, apart, left = [], [], None
    while True:
        inner = rest.select(F.col("parent").alias("child")).distinct().withColumn("stays", F.lit(True))
        both = materialize(rest.join(inner, "child", "left").select(*_LINK, F.coalesce("stays", F.lit(False)).alias("stays")), "peel-round")
        seen = both.agg(F.count("*"), F.count_if("stays")).collect()[0]
        rest, left, went = both.where("stays").select(*_LINK), seen[1], seen[0] - seen[1]
        if went:
            stages.append(both.where("not stays").select(*_LINK))
        if left and went < SLOW * seen[0]:
            gone, rings, rest = _contract(rest)
            if gone is not None:
                stages.append(gone.select(*_LINK))
            if rings is not None:
                apart.append(rings.select(*_LINK))
            if gone is None and rings is None and not went:
                break
        if not left:
            break
    return stages, reduce(DataFrame.unionByName, [rest.select(*_LINK), *apart])


def _nodes(links: DataFrame, *ends: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [links.select(F.col(e).alias("node")) for e in ends]).distinct()


def _offers(links: DataFrame, facts: DataFrame) -> DataFrame:
    """What parents hand down: ``(node, root, hops, via)``, the shortest way to each root once; a circle counts as a root without a name."""
    down = links.join(facts.select(F.col("node").alias("parent"), "root", "hops"), "parent")
    down = down.select(F.col("child").alias("node"), "root", F.when(F.col("root").isNotNull(), F.struct((F.col("hops") + F.col("w")).alias("hops"), "via")).alias("b"))
    return down.groupBy("node", "root").agg(F.min("b").alias("b")).select("node", "root", "b.*")


def _core_facts(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The facts of links among which no leaf is left: circles and what stands above them."""
    # what stands above all circles goes from the top; whatever is left then has a parent that is left, so its ways up never end
    rest, before = links, None
    while True:
        stays = _nodes(rest, "child").withColumnRenamed("node", "parent")
        rest = materialize(rest.join(stays, "parent", "left_semi").select(*_LINK), "core-rest")
        now = rest.count()
        if now == before:
            break
        before = now
    looped = _nodes(rest, "child").select("node", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("hops"), F.lit(None).cast("string").alias("via"))
    # ways from the tops, improved until none gets shorter
    here = roots.join(_nodes(links, "parent"), "node", "left_semi")
    facts = materialize(here.withColumn("news", F.lit(True)), "core-facts")
    while not facts.where("news").isEmpty():
        old = facts.select("node", "root", F.struct("hops", "via").alias("b"), F.lit(True).alias("old"))
        new = _offers(links, facts.where("news")).select("node", "root", F.struct("hops", "via").alias("b"), F.lit(False).alias("old"))
        best = old.unionByName(new).groupBy("node", "root").agg(F.min("b").alias("b"), F.min(F.when(F.col("old"), F.col("b"))).alias("o"))
        facts = materialize(best.select("node", "root", "b.*", (F.col("o").isNull() | (F.col("b") < F.col("o"))).alias("news")), "core-facts")
    return facts.join(here.select("node"), "node", "left_anti").select("node", "root", "hops", "via").unionByName(looped)


def hierarchy(links: DataFrame) -> DataFrame:
    """``(node, root, hops, via)`` for every node that has a link.

    ``links`` has ``child`` and ``parent``, both known nodes, each pair once
    (see :func:`clean_links`). One row for each root above a node; ``hops`` is
    the length of the shortest way to it and ``via`` the parent it goes
    through (of equal ones the one that sorts first). A root has itself, with
    no hop and no ``via``. Where a way upwards runs into a circle there is a
    row with nulls, beside those of the roots, if any. An empty table gives an
    empty result.
    """
    links = materialize(links, "peel-links")
    roots = _nodes(links, "parent").join(_nodes(links, "child"), "node", "left_anti")
    facts = Growing(links.sparkSession, "peel-facts")
    known = facts.add(roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("string").alias("via")))
    stages, rest = peel_links(links)
    if not rest.isEmpty():
        known = facts.add(_core_facts(rest, known))
    for leaves in reversed(stages):
        known = facts.add(_offers(leaves, known))
    return known


def paths(facts: DataFrame) -> DataFrame:
    """``(node, root, hops, path)``: the way from each root down to the node, both included; null for a circle's row.

    Each node holds a part of its way and points to the node where that part
    begins; parts are joined to parts, so that they double each time.
    """
    part = facts.where("root is not null").select("node", "root", F.array("node").alias("path"), F.col("via").alias("at"))
    part = materialize(part, "path-parts")
    while not part.where("at is not null").isEmpty():
        above = part.select(F.col("node").alias("at"), "root", F.col("path").alias("head"), F.col("at").alias("next"))
        step = part.where("at is not null").join(above, ["at", "root"]).select("node", "root", F.concat("head", "path").alias("path"), F.col("next").alias("at"))
        part = materialize(part.where("at is null").unionByName(step), "path-parts")
    ring = facts.where("root is null").select("node", "root", F.lit(None).cast("array<string>").alias("path"), "hops")
    return facts.select("node", "root", "hops").join(part.drop("at"), ["node", "root"]).select("node", "root", "hops", "path").unionByName(ring)


def descendants(links: DataFrame) -> DataFrame:
    """``(ancestor, node)``, once for every node below another; the lists are kept as rows, since a root may have a third of all nodes below it.

    ``far`` has the pairs exactly 2 ** k hops apart and ``near`` those fewer
    apart; one join lengthens both, so that a chain takes as many rounds as
    its length has bits and no pair is found by every node between. The rounds
    end when ``near`` no longer grows, which holds for circles too, whose nodes
    are below themselves.
    """
    pair = ("ancestor", "node")
    far = materialize(links.select(F.col("parent").alias("ancestor"), F.col("child").alias("node")).distinct(), "lists-far")
    near, count = far, far.count()
    while count:
        above = far.select("ancestor", F.col("node").alias("via"))
        wider = near.unionByName(above.join(near.withColumnRenamed("ancestor", "via"), "via").select(*pair))
        far = materialize(above.join(far.withColumnRenamed("ancestor", "via"), "via").select(*pair).distinct(), "lists-far")
        near = materialize(wider.unionByName(far).distinct(), "lists-near")
        now = near.count()
        if now == count:
            break
        count = now
    return near.select(*pair)
