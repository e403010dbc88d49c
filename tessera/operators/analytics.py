"""Analytics over tags, vectors and groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, mean_vector, minus, unit


def cooccurrence(tags: DataFrame, tag: str, item: str) -> DataFrame:
    """``(tag, neighbor, together)``: in how many items two different tags stand together, both ways.

    Tags of an item are made unique first. The pairs are those of one item's
    tags, which the tagging bounds; the items are joined with themselves only
    by their own key.
    """
    t = tags.select(F.col(item).alias("i"), F.col(tag).alias("tag")).where("i is not null and tag is not null").distinct()
    pairs = t.join(t.withColumnRenamed("tag", "neighbor"), "i").where("tag != neighbor")
    return pairs.groupBy("tag", "neighbor").agg(F.count("*").alias("together"))


def best_overlap(groups: DataFrame, earlier: DataFrame) -> DataFrame:
    """``(grp, predecessor, jaccard)``: for each group the earlier one whose members it shares most.

    Both have ``grp`` and ``member``. Of equal ones the greatest name counts;
    groups that share nothing have no row.
    """
    a, b = groups.distinct(), earlier.distinct()
    na, nb = a.groupBy("grp").agg(F.count("*").alias("na")), b.groupBy(F.col("grp").alias("bg")).agg(F.count("*").alias("nb"))
    both = a.join(b.withColumnRenamed("grp", "bg"), "member").groupBy("grp", "bg").agg(F.count("*").alias("n"))
    j = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    return both.join(na, "grp").join(nb, "bg").withColumn("j", j).groupBy("grp").agg(F.max(F.struct("j", "bg")).alias("m")).select("grp", F.col("m.bg").alias("predecessor"), F.col("m.j").alias("jaccard"))


def axis_vector(vectors: DataFrame, vector: str, positive: Column, negative: Column) -> DataFrame:
    """One row ``axis``: the direction from the mean of the negative examples to that of the positive ones."""
    side = F.when(positive, F.lit("p")).when(negative, F.lit("n"))
    means = mean_vector(vectors.withColumn("_side", side).where("_side is not null"), ["_side"], vector)
    both = means.groupBy().pivot("_side", ["n", "p"]).agg(F.first("mean"))
    return both.select(unit(minus(unit(F.col("p")), unit(F.col("n")))).alias("axis"))


def readings(vectors: DataFrame, vector: str, axes: DataFrame) -> DataFrame:
    """Each vector's cosine with each axis (``name``, ``axis``); the axes are a small declared set."""
    return vectors.crossJoin(F.broadcast(axes)).withColumn("value", cosine(F.col(vector), F.col("axis"))).drop("axis")


def opposition_edges(nodes: DataFrame, oppositions: DataFrame, node: str, category: str) -> DataFrame:
    """Pairs of nodes whose categories are declared opposites, each unordered pair once.

    ``oppositions`` (``a``, ``b``, ``reason``) is a declared list. Join by
    category on both sides; within one category the smaller node goes first.
    """
    left = nodes.select(F.col(node).alias("left"), F.col(category).alias("a"))
    right = nodes.select(F.col(node).alias("right"), F.col(category).alias("b"))
    pairs = left.join(F.broadcast(oppositions), "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("left") < F.col("right")))
    return pairs.select("left", "right", "a", "b", "reason")


def fingerprint(items: DataFrame, source: str, vector: str, domain: str) -> DataFrame:
    """``(source, mean, shares)``: each source's mean vector and the shares of its domains."""
    means = mean_vector(items, [source], vector)
    counts = items.where(F.col(domain).isNotNull()).groupBy(source, domain).agg(F.count("*").alias("n"))
    total = counts.groupBy(source).agg(F.sum("n").alias("t"))
    part = counts.join(total, source).select(source, F.struct(F.col(domain), (F.col("n") / F.col("t")).alias("share")).alias("e"))
    return means.join(part.groupBy(source).agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("shares")), source, "left")


def kmeans(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 7, rounds: int = 25) -> DataFrame:
    """``(key, cluster, distance)``: k-means by cosine, in rounds of one aggregate each.

    Each round sends the k centres out and sums the members by cluster and
    position, so only k vectors ever reach the driver. The first centres are
    chosen by the key's hash, far from each other (a seeded k-means++ over a
    bounded sample of 50 k rows).
    """
    data = vectors.select(key, unit(F.col(vector)).alias("v")).where(F.size("v") > 0)
    draw = data.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(50 * k).collect()
    if not draw:
        return data.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
    points = np.array([r["v"] for r in draw])
    rng, centres = np.random.default_rng(seed), [points[0]]
    while len(centres) < min(k, len(points)):
        gap = np.clip(1 - (points @ np.array(centres).T).max(axis=1), 0, None)
        centres.append(points[rng.choice(len(points), p=gap / gap.sum())] if gap.sum() > 0 else points[len(centres)])
    centres = np.array(centres)

    def assigned(centres: np.ndarray) -> DataFrame:
        shared = data.sparkSession.sparkContext.broadcast(centres)

        def run(batches):
            for b in batches:
                s = np.array(b["v"].tolist()) @ shared.value.T
                at = s.argmax(axis=1)
                yield pd.DataFrame({key: b[key], "cluster": at.astype("int32"), "distance": 1 - s[np.arange(len(s)), at], "v": b["v"]})

        return data.mapInPandas(run, f"{key} {data.schema[key].dataType.simpleString()}, cluster int, distance double, v array<double>")

    for _ in range(rounds):
        sums = assigned(centres).select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect()
        new = centres.copy()
        for c in {r["cluster"] for r in sums}:
            v = np.array([r["x"] for r in sorted((r for r in sums if r["cluster"] == c), key=lambda r: r["i"])])
            new[c] = v / (np.linalg.norm(v) or 1.0)
        moved, centres = float(np.abs(new - centres).max()), new
        if moved < 1e-6:
            break
    return assigned(centres).drop("v")


def centroid_distances(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """``(left, right, distance)``: the cosine distance of the mean vectors of each two groups; groups are few."""
    means = mean_vector(vectors, [group], vector)
    left, right = means.select(F.col(group).alias("left"), F.col("mean").alias("_a")), means.select(F.col(group).alias("right"), F.col("mean").alias("_b"))
    return left.join(right, F.col("left") < F.col("right")).select("left", "right", (1 - cosine(F.col("_a"), F.col("_b"))).alias("distance"))


#: Vectors among which the number of clusters is chosen, the first by the key's hash; a parameter with this default.
SILHOUETTE_SAMPLE = 2000


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """How much nearer points are to their own cluster than to the next one, by cosine; 0 for a cluster of one, mean of all."""
    gap = 1 - points @ points.T
    names = np.unique(labels)
    if len(names) < 2:
        return 0.0
    sums = np.stack([gap[:, labels == c].sum(axis=1) for c in names], axis=1)
    sizes = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    rows = np.arange(len(points))
    inner = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    others = sums / sizes
    others[rows, own] = np.inf
    outer = others.min(axis=1)
    score = np.where(sizes[own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-12), 0.0)
    return float(score.mean())


def _local_kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    rng, centres = np.random.default_rng(seed), [points[0]]
    while len(centres) < k:
        gap = np.clip(1 - (points @ np.array(centres).T).max(axis=1), 0, None)
        centres.append(points[rng.choice(len(points), p=gap / gap.sum())] if gap.sum() > 0 else points[len(centres)])
    centres = np.array(centres)
    for _ in range(rounds):
        at = (points @ centres.T).argmax(axis=1)
        sums = np.array([points[at == c].sum(axis=0) if (at == c).any() else centres[c] for c in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return (points @ centres.T).argmax(axis=1)


def kmeans_auto(vectors: DataFrame, key: str, vector: str, least: int = 2, most: int = 8, seed: int = 7, sample: int = SILHOUETTE_SAMPLE) -> tuple[int, DataFrame]:
    """``(k, clusters)``: the number of clusters from ``least`` to ``most`` with the best silhouette, the smaller of equals, and all vectors clustered so.

    The number is chosen by clustering a bounded sample alone; then every
    vector is clustered, in as many rounds as one number needs.
    """
    drawn = vectors.where(F.size(vector) > 0).select(key, unit(F.col(vector)).alias("v")).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample).collect()
    points, best = np.array([r["v"] for r in drawn]), (-2.0, least)
    for k in range(least, min(most, len(drawn) - 1) + 1):
        score = silhouette(points, _local_kmeans(points, k, seed))
        if score > best[0] + 1e-12:
            best = (score, k)
    return best[1], kmeans(vectors, key, vector, best[1], seed)
