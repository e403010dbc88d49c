"""Copies and near copies of texts."""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sets as S
from ..functions.hashing import SIGNATURE, minhash, simhash
from ..functions.sets import plain_text
from ..functions.text import shingles
from ..functions.vectors import hamming
from ..session import materialize

#: Word shingles of five words; near copies share 0.8 of them or more.
WORDS, SIMILAR = 5, 0.8


def exact_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, class_id, copies)``: texts that are equal share the least key. Null texts have no class."""
    own = df.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("h"))
    sums = own.groupBy("h").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    return own.join(sums, "h").select(key, "class_id", "copies")


#: Sets that are compared in one task; larger classes of sizes are divided.
CELL = 200_000
#: Bits of the filter that holds back texts without a partner.
_FILTER = 1 << 25


def _summed(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], blocks: int = 64) -> list[tuple[int, bytes]]:
    """One array of a task each, merged block by block on the cluster: ``(block, bytes)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = of(batches)
        kind = whole.dtype.str
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(whole, blocks)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(blocks), pa.int32()), "kind": [kind] * blocks, "x": parts})

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        parts = (np.frombuffer(zlib.decompress(x), dtype=kind) for kind, x in zip(rows["kind"], rows["x"]))
        return pd.DataFrame({"i": rows["i"].to_numpy()[:1], "x": [reduce(merge, parts).tobytes()]})

    return [(r["i"], r["x"]) for r in df.mapInArrow(run, "i int, kind string, x binary").groupBy("i").applyInPandas(gather, "i int, x binary").collect()]


def near_pairs(df: DataFrame, key: str, text: str, words: int = WORDS, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs ``(a, b, jaccard)`` of different shingle sets, exactly, and ``(key, class_id)``.

    Copies are one class and never paired. Candidates come from a prefix of
    each set in an order by rarity: two sets that share ``similar`` of their
    shingles must share one in their prefixes, so none is lost. The order is
    that of a table of counters over all texts, of a fixed size. What goes
    over the network is not the sets but their prefixes and a map of parities
    that bounds in how many shingles two sets differ; sets of about one size
    meet in one task. Whole sets are made only of texts in pairs that remain.
    """
    spark = df.sparkSession
    plain = df.select(key, plain_text(text).alias("t"))
    kind = df.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(S.COUNTERS, dtype=np.uint32)
        for b in batches:
            for h in S.word_runs(b.column(0).to_pylist(), words):
                counts[S.counter(h)] += 1  # two runs of one text under one counter count once, which only changes the order
        return counts

    rare = np.zeros(S.COUNTERS, dtype=np.uint8)
    step = S.COUNTERS // 64
    for i, x in _summed(plain.select("t"), count, lambda x, y: x + y):
        rare[i * step : (i + 1) * step] = S.rarity(np.frombuffer(x, dtype=np.uint32))
    shared_rare = spark.sparkContext.broadcast(rare)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = S.size_bounds(1 << 20, similar)
        for b in batches:
            rows = {"h": [], "n": [], "z": [], "p": [], "m": []}
            keep = []
            for i, h in enumerate(S.word_runs(b.column(1).to_pylist(), words)):
                if not len(h):
                    continue
                if len(h) >= bounds[-3]:
                    bounds = S.size_bounds(2 * len(h), similar)
                z = bisect_right(bounds, len(h)) - 1
                keep.append(i)
                for c, v in zip(rows, (hashlib.blake2b(h.tobytes(), digest_size=16).digest(), len(h), z, S.prefix(h, shared_rare.value, similar), S.parities(h, S.width(bounds, z + 1)))):
                    rows[c].append(v)
            kinds = {"h": pa.binary(), "n": pa.int32(), "z": pa.int32(), "p": pa.binary(), "m": pa.binary()}
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *[pa.array(v, kinds[c]) for c, v in rows.items()]], [key, *rows])

    sets = materialize(plain.mapInArrow(sets_of, f"{key} {kind.simpleString()}, h binary, n int, z int, p binary, m binary"), "near-sets")
    least = sets.groupBy("h").agg(F.min(key).alias("class_id"), F.first("z").alias("z"))
    members = sets.select(key, "h").join(least.select("h", "class_id"), "h").select(key, "class_id")
    # each class of sizes is a cell, with the class below it; one row for each class
    sizes = {r["z"]: r["count"] for r in least.groupBy("z").count().collect()}
    blocks = {z: max(1, math.ceil((sizes.get(z, 0) + sizes.get(z - 1, 0)) / CELL)) for z in sizes}
    split = F.create_map(*[F.lit(x) for z, g in blocks.items() for x in (z, g)]) if blocks else F.create_map(F.lit(0), F.lit(1))
    reps = sets.groupBy("h").agg(F.min(key).alias("rep"), *[F.first(c).alias(c) for c in "nzpm"])
    cells = reps.withColumn("cell", F.explode(F.array("z", F.col("z") + 1))).withColumn("g", F.try_element_at(split, "cell")).where("g is not null")
    cells = cells.withColumn("block", F.pmod(F.xxhash64("rep"), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    cells = cells.select("rep", "h", *"nzpm", "block", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def meet(at: tuple, rows: pa.Table) -> pa.Table:
        cell, i, j = (x.as_py() for x in at)
        n, block = rows["n"].to_numpy(), rows["block"].to_numpy()
        # maps of the class below are as wide as those of this one; those of this one may be twice as wide and are folded
        maps = rows["m"].to_pylist()
        least = min(map(len, maps))
        folded = [np.frombuffer(x, dtype=np.uint8).reshape(-1, least) for x in maps]
        maps = np.stack([np.bitwise_xor.reduce(x, axis=0) for x in folded])
        own = n[rows["z"].to_numpy() == cell]
        if not len(own):
            return pa.table({c: rows["h" if c[0] == "h" else "rep"][:0] for c in ("a", "ha", "b", "hb")})
        a, b = S.like_pairs(n, rows["p"].to_pylist(), maps, int(own.min()), lambda x, y: (i == j) | (block[x] != block[y]), similar)
        a, b = pa.array(a), pa.array(b)
        return pa.table({"a": rows["rep"].take(a), "ha": rows["h"].take(a), "b": rows["rep"].take(b), "hb": rows["h"].take(b)})

    met = cells.groupBy("cell", "i", "j").applyInArrow(meet, f"a {kind.simpleString()}, ha binary, b {kind.simpleString()}, hb binary").where("a != b")
    swap = F.struct(F.col("b").alias("a"), F.col("hb").alias("ha"), F.col("a").alias("b"), F.col("ha").alias("hb"))
    cand = materialize(met.select(F.when(F.col("a") < F.col("b"), F.struct("a", "ha", "b", "hb")).otherwise(swap).alias("p")).select("p.*"), "near-cand")

    place = lambda c: F.pmod(F.xxhash64(c), F.lit(_FILTER)).alias("f")

    def marked(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(_FILTER, dtype=bool)
        for b in batches:
            bits[b.column(0).to_numpy()] = True
        return np.packbits(bits)

    held = np.zeros(_FILTER // 8, dtype=np.uint8)
    for i, x in _summed(cand.select(F.explode(F.array("a", "b")).alias("k")).select(place("k")), marked, lambda x, y: x | y):
        held[i * len(held) // 64 : (i + 1) * len(held) // 64] = np.frombuffer(x, dtype=np.uint8)
    shared_held = spark.sparkContext.broadcast(held)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(2).to_numpy()
            yield b.filter(pa.array((shared_held.value[f >> 3] >> (7 - (f & 7)).astype(np.uint8) & 1).astype(bool))).select([0, 1])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = list(S.word_runs(b.column(1).to_pylist(), words))
            sums = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in runs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.binary()), pa.array([h.view(np.int64) for h in runs], pa.list_(pa.int64()))], ["k", "h", "s"])

    # rows may be repeated, and texts of one key may differ: a set is told by both
    met_texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), place(key)).mapInArrow(kept, f"k {kind.simpleString()}, t string")
    s = met_texts.select("k", plain_text("t").alias("t")).mapInArrow(full, f"k {kind.simpleString()}, h binary, s array<bigint>")
    s = materialize(s.dropDuplicates(["k", "h"]), "near-full")
    both = cand.join(s.select(F.col("k").alias("a"), F.col("h").alias("ha"), F.col("s").alias("sa")), ["a", "ha"]).join(s.select(F.col("k").alias("b"), F.col("h").alias("hb"), F.col("s").alias("sb")), ["b", "hb"])
    shared = F.size(F.array_intersect("sa", "sb"))
    pairs = both.withColumn("jaccard", shared / (F.size("sa") + F.size("sb") - shared)).where(F.col("jaccard") >= similar).select("a", "b", "jaccard")
    return pairs, members


#: The fingerprint's blocks, from the highest bit; two prints three bits apart agree in three of six blocks.
_BLOCKS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))


def simhash_pairs(df: DataFrame, key: str, text: str, distance: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs ``(a, b, distance)`` of different fingerprints at most ``distance`` (3 or less) bits apart, and ``(key, class_id)``.

    With ``distance`` bits in as many of six blocks, the others are equal, so
    the join by each choice of three blocks (about 32 bits) loses no pair, and
    chance meetings are rare however many prints there are.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be from 0 to 3")
    prints = materialize(df.select(key, simhash(F.col(text)).alias("f")).where("f != 0"), "sim-prints")
    reps = prints.groupBy("f").agg(F.min(key).alias("rep"))
    block = [F.shiftrightunsigned("f", low).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for low, width in _BLOCKS]
    three = list(combinations(range(len(_BLOCKS)), 3))
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("i"), (block[x] * 2**22 + block[y] * 2**11 + block[z]).alias("v")) for n, (x, y, z) in enumerate(three)])).alias("k")
    b = reps.select("rep", "f", keys).select("rep", "f", "k.*")
    other = b.select(F.col("rep").alias("rep2"), F.col("f").alias("f2"), "i", "v")
    near = b.join(other, ["i", "v"]).where((F.col("rep") < F.col("rep2")) & (hamming(F.col("f"), F.col("f2")) <= distance))
    pairs = near.select(F.col("rep").alias("a"), F.col("rep2").alias("b"), hamming(F.col("f"), F.col("f2")).alias("distance")).distinct()
    return pairs, prints.join(reps, "f").select(key, F.col("rep").alias("class_id"))


def connected(links: DataFrame) -> DataFrame:
    """``(node, least)``: every node of ``links`` (``a``, ``b``) with the least node it is linked to, by alternating large and small stars.

    Each step points nodes to smaller neighbours, larger ones first; rounds
    are few even for long chains. Links to oneself are ignored.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    rest = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct(), "star-links")
    while True:
        e = both(rest)
        low = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = e.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        large = materialize(large, "star-large")
        # now of each node its smaller neighbours: all of them, and the node, point to the least
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct()
        small = materialize(small, "star-links")
        if small.count() == rest.count() and small.join(rest, ["a", "b"], "left_anti").isEmpty():
            break
        rest = small
    return rest.select(F.col("b").alias("node"), F.col("a").alias("least")).unionByName(rest.select(F.col("a").alias("node"), F.col("a").alias("least")).distinct())


#: Parts of titles that mark an edition or an extract; fixed values.
EDITIONS = (
    "annotated", "annoté", "critical edition", "édition critique", "illustrated", "illustré", "abridged", "abrégé", "revised", "revu", "expurgated", "kommentiert",
    "with notes", "avec notes", "edited by", "édité par", "second edition", "deuxième édition", "new edition", "nouvelle édition",
)
EXCERPTS = ("selections from", "extraits de", "excerpt", "extrait", "selected", "choisis", "an anthology of", "chapters from", "chapitres de", "auszug")
#: From how many times the length on a text is an extract of another; fixed value.
EXCERPT_RATIO = 4


def _has(title: Column, marks: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(Column.__or__, [F.contains(F.lower(title), F.lit(m)) for m in marks]), F.lit(False))


def _compatible(cells: DataFrame, on: list[str], parts: list[str], bands: bool) -> DataFrame:
    """Pairs ``c1``, ``c2`` of cells of one group whose ``parts`` are equal or blank on one side, and whose lengths may be of one text."""
    left, right = (cells.select(*on, *[F.col(c).alias(f"{c}{n}") for c in cells.columns if c not in on]) for n in (1, 2))
    ok = reduce(Column.__and__, [(F.col(f"{p}1") == F.col(f"{p}2")) | (F.col(f"{p}1") == "") | (F.col(f"{p}2") == "") for p in parts])
    if bands:
        same = (F.col("band1") == F.col("band2")) | (F.col("band1") < 0) | (F.col("band2") < 0)
        up = (F.col("band2") == F.col("band1") + 1) & (F.col("low2") < EXCERPT_RATIO * F.col("high1"))
        down = (F.col("band1") == F.col("band2") + 1) & (F.col("low1") < EXCERPT_RATIO * F.col("high2"))
        ok = ok & (same | up | down)
    return left.join(right, on).where(ok)


def _rung(df: DataFrame, on: list[str], parts: list[str], bands: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(partners, links)`` of the rows that share ``on``: a compatible other row of each, and links that join all that are compatible.

    Rows are first gathered into cells of equal parts (and bands of length,
    each within the ratio), so that only cells are compared and never rows.
    """
    keyed = df.withColumn("band", F.when(F.coalesce("chars", F.lit(0)) > 0, F.floor(F.log(float(EXCERPT_RATIO), F.col("chars").cast("double"))).cast("int")).otherwise(-1)) if bands else df.withColumn("band", F.lit(-1))
    cell = [*on, *parts, "band"]
    cells = keyed.groupBy(*cell).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("chars").alias("low"), F.max("chars").alias("high"), F.min_by("id", "chars").alias("shortest"), F.max_by("id", "chars").alias("longest"))
    cells = materialize(cells.withColumn("c", F.struct(*parts, "band")), "ladder-cells")
    pairs = _compatible(cells, on, [*parts], bands)
    rows = keyed.select("id", "chars", *on, F.struct(*parts, "band").alias("c1"))
    met = rows.join(pairs.select(*on, "c1", "band1", "band2", "first2", "last2", "low2", "high2", "shortest2", "longest2"), [*on, "c1"])
    if bands:
        met = met.where((F.col("band1") == F.col("band2")) | (F.col("band1") < 0) | (F.col("band2") < 0) | ((F.col("band2") > F.col("band1")) & (F.col("low2") < EXCERPT_RATIO * F.col("chars"))) | ((F.col("band2") < F.col("band1")) & (F.col("chars") < EXCERPT_RATIO * F.col("high2"))))
    near = F.when((F.col("band1") < 0) | (F.col("band2") < 0) | (F.col("band1") == F.col("band2")), F.array("first2", "last2")).when(F.col("band2") > F.col("band1"), F.array("shortest2")).otherwise(F.array("longest2")) if bands else F.array("first2", "last2")
    partners = met.select("id", F.explode(near).alias("other")).where("id != other").groupBy("id").agg(F.min("other").alias("other"))
    within = keyed.join(cells.select(*cell, "first"), cell).select(F.col("first").alias("a"), F.col("id").alias("b"))
    # two neighbouring bands are joined by their nearest texts, others by any
    ends = F.when((F.col("band1") >= 0) & (F.col("band2") > F.col("band1")), F.struct(F.col("longest1").alias("a"), F.col("shortest2").alias("b"))).otherwise(F.struct(F.col("first1").alias("a"), F.col("first2").alias("b")))
    across = pairs.where((F.col("band2") >= F.col("band1")) | (F.col("band2") < 0)).select(ends.alias("e")).select("e.*")
    return partners, within.unionByName(across).where("a != b").distinct()


def ladder(docs: DataFrame, near: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(id, kind, duplicate_of, similarity, cluster, representative)``: each text's best match, and the group of all that match.

    ``docs`` has ``id``, ``raw`` and ``normalized`` (hashes), ``language``,
    ``translator``, ``edition``, ``title``, ``work`` (the key of the work),
    ``identifiers`` (an array), ``chars`` and ``quality``; ids are unique,
    nulls mean unknown. Rungs from the top: equal bytes, equal normalised
    text, a shared identifier, the same work, and ``near``, the pairs and
    members of :func:`simhash_pairs`. Equal hashes need nothing else; below
    them languages, translators and editions must not differ, and for the last
    two rungs neither may be an extract of the other or four times as long.
    Who only meets texts that differ so is ``related``. Of several partners on
    the best rung one is named, the same on every run. ``cluster`` is the least id of all linked
    directly or through others, ``representative`` the one of most quality,
    then length, then the greatest id.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = docs.select("id", "raw", "normalized", blank("language").alias("lang"), blank("translator").alias("tr"), blank("edition").alias("ed"), "work", "identifiers", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), F.coalesce("quality", F.lit(0.0)).alias("quality"), _has(F.col("title"), EDITIONS).alias("marked"), _has(F.col("title"), EXCERPTS).alias("part"))
    own = materialize(own, "ladder-docs")

    def equal(c: str) -> tuple[DataFrame, DataFrame]:
        some = own.where(F.coalesce(F.col(c), F.lit("")) != "").select("id", "chars", c, F.lit("").alias("all"))
        return _rung(some, [c], ["all"])

    named = own.select("id", "chars", "lang", "tr", "ed", "marked", F.explode(F.array_distinct("identifiers")).alias("name"))
    work = own.where("work is not null")
    rungs = {
        "exact_raw": equal("raw"),
        "exact_normalized": equal("normalized"),
        "identifier": _rung(named, ["name", "marked"], ["lang", "tr", "ed"]),
        "title_author": _rung(work, ["work", "marked", "part"], ["lang", "tr", "ed"], bands=True),
    }
    value = {"exact_raw": 1.0, "exact_normalized": 1.0, "identifier": 1.0, "title_author": 0.95}
    found = reduce(DataFrame.unionByName, [p.select("id", F.lit(k).alias("kind"), "other", F.lit(value[k]).alias("similarity")) for k, (p, _) in rungs.items()])
    links = reduce(DataFrame.unionByName, [x.select("a", "b") for _, x in rungs.values()])
    if near is not None:
        pairs, members = near
        facts = own.select("id", "lang", "tr", "ed", "marked", "part", "chars")
        classes = members.withColumnsRenamed({members.columns[0]: "id"}).join(facts, "id")
        each = pairs.select("a", "b", "distance").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(members.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(0).alias("distance")).distinct())
        # copies of a print are gathered by what must agree before they meet
        kinds = ["lang", "tr", "ed", "marked", "part", "band"]
        banded = classes.withColumn("band", F.when(F.col("chars") > 0, F.floor(F.log(float(EXCERPT_RATIO), F.col("chars").cast("double"))).cast("int")).otherwise(-1))
        cells = materialize(banded.groupBy("class_id", *kinds).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("chars").alias("low"), F.max("chars").alias("high")), "ladder-near")
        one = cells.select(F.col("class_id").alias("a"), *[F.col(c).alias(f"{c}1") for c in (*kinds, "first", "last", "low", "high")])
        two = cells.select(F.col("class_id").alias("b"), *[F.col(c).alias(f"{c}2") for c in (*kinds, "first", "last", "low", "high")])
        alike = lambda c: (F.col(f"{c}1") == F.col(f"{c}2")) | (F.col(f"{c}1") == "") | (F.col(f"{c}2") == "")
        size = (F.col("band1") < 0) | (F.col("band2") < 0) | ((F.col("low2") < EXCERPT_RATIO * F.col("high1")) & (F.col("low1") < EXCERPT_RATIO * F.col("high2")))
        met = each.join(one, "a").join(two, "b").where(alike("lang") & alike("tr") & alike("ed") & (F.col("marked1") == F.col("marked2")) & (F.col("part1") == F.col("part2")) & size)
        rows = banded.select("id", F.col("class_id").alias("a"), *[F.col(c).alias(f"{c}1") for c in kinds])
        hit = rows.join(met.select("a", *[f"{c}1" for c in kinds], "first2", "last2", "distance"), ["a", *[f"{c}1" for c in kinds]]).select("id", F.explode(F.array("first2", "last2")).alias("other"), "distance").where("id != other")
        found = found.unionByName(hit.select("id", F.lit("near").alias("kind"), "other", (1 - F.col("distance") / 64).alias("similarity")))
        links = links.unionByName(met.select(F.col("first1").alias("a"), F.col("first2").alias("b"))).unionByName(banded.join(cells.select("class_id", *kinds, "first"), ["class_id", *kinds]).select(F.col("first").alias("a"), F.col("id").alias("b"))).where("a != b")
    # whoever shares a name or a work with anyone, but matches no one
    met = reduce(DataFrame.unionByName, [_rung(d.select("id", "chars", k, F.lit("").alias("all")), [k], ["all"])[0] for d, k in ((named, "name"), (work, "work"))])
    order = F.when(F.col("kind") == "exact_raw", 0).when(F.col("kind") == "exact_normalized", 1).otherwise(2)
    rank = F.struct(order.alias("o"), (-F.col("similarity")).alias("s"), F.when(F.col("kind") == "identifier", 0).when(F.col("kind") == "near", 1).otherwise(2).alias("k"), "other", "kind", "similarity")
    best = found.groupBy("id").agg(F.min(rank).alias("b"))
    related = met.groupBy("id").agg(F.min("other").alias("kin"))
    groups = connected(links)
    clustered = own.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("least", "id"))
    chosen = clustered.groupBy("cluster").agg(F.max(F.struct("quality", "chars", "id")).alias("r")).select("cluster", F.col("r.id").alias("representative"))
    out = clustered.join(best, "id", "left").join(related, "id", "left").join(chosen, "cluster")
    return out.select(
        "id",
        F.coalesce("b.kind", F.when(F.col("kin").isNotNull(), "related")).alias("kind"),
        F.coalesce("b.other", "kin").alias("duplicate_of"),
        F.when(F.col("b").isNotNull(), F.col("b.similarity")).otherwise(0.0).alias("similarity"),
        "cluster", "representative",
    )


def signatures(df: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """``(key, signature)``: the minima of each text's shingles; texts without words have none."""
    return df.select(key, minhash(shingles(F.col(text), words), SIGNATURE).alias("signature")).where("signature is not null")


def links_per_row(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``(key, class_id, links)``: each row's class and to how many other classes it is linked."""
    n = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(n, "class_id", "left").select(key, "class_id", F.coalesce("links", F.lit(0)).alias("links"))

