"""Queries of problem 1."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import clean_id, table
from .labels import label_language
from .langid import LANGUAGES, MIN_RUN, MIN_TEXT, Network, sample, segments, train

_FITTED: dict[str, Network] = {}
_EVIDENCE = [f"e_{x}" for x in LANGUAGES]


def fitted(spark: SparkSession, sf_dir: str) -> Network:
    """The network, trained on a bounded sample of the labelled documents and golden texts.

    It follows from the sample alone, so queries of one session that draw the
    same sample train it once.
    """
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text", label_language(F.col("lang")).alias("lang"))
    golden = table(spark, sf_dir, "golden_classification").select(F.concat(F.lit("g"), "id").alias("key"), "text", label_language(F.col("language")).alias("lang"))
    texts, labels = sample(docs.unionByName(golden), "key", "text", F.col("lang"))
    digest = hashlib.sha256(repr((texts, labels)).encode("utf-8", "replace")).hexdigest()
    if digest not in _FITTED:
        _FITTED.clear()
        _FITTED[digest] = train(texts, labels)
    return _FITTED[digest]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """By kind: ``(record_id, part, chars, text)`` of all texts, and ``(record_id, label)`` of all records."""
    cand = table(spark, sf_dir, "corpus_candidates").select(clean_id("candidate_id").alias("record_id"), "language", "updated_at", F.get_json_object("raw_metadata_json", "$.description").alias("text"))
    # the part names the version: which is the latest is found without moving the texts
    version = F.coalesce(F.col("updated_at").cast("string"), F.lit(""))
    newest = cand.groupBy("record_id").agg(F.max_by("language", F.struct("updated_at", "language")).alias("label"), F.max(version).alias("part"))
    chunk = table(spark, sf_dir, "chunks").select(F.col("source_id").cast("string").alias("record_id"), F.col("id").cast("string").alias("part"), F.col("content").alias("text"))
    golden = table(spark, sf_dir, "golden_classification")
    docs = table(spark, sf_dir, "documents")
    whole = F.lit("")
    texts = {
        "candidate": cand.select("record_id", version.alias("part"), "text"),
        "source": chunk,
        "golden": golden.select(F.col("id").alias("record_id"), whole.alias("part"), "text"),
        "document": docs.select(F.col("doc_id").cast("string").alias("record_id"), whole.alias("part"), "text"),
    }
    labels = {
        "candidate": newest,
        "source": table(spark, sf_dir, "sources").groupBy(F.col("id").cast("string").alias("record_id")).agg(F.max("language").alias("label")),
        "golden": golden.select(F.col("id").alias("record_id"), F.col("language").alias("label")),
        "document": docs.select(F.col("doc_id").cast("string").alias("record_id"), F.col("lang").alias("label")),
    }
    return {k: v.withColumn("chars", F.length("text").cast("long")).where("chars > 0") for k, v in texts.items()}, labels


def read_all(spark: SparkSession, sf_dir: str, evidence: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(segments, labels)`` of every record of all kinds; repeated rows and old versions are gone.

    Without ``evidence`` the segments' sums for each language are left out.
    """
    net = fitted(spark, sf_dir)
    texts, labels = _parts(spark, sf_dir)
    found, named = None, None
    for kind, df in texts.items():
        seg = segments(df, ["record_id", "part", "chars"], "text", net)
        own = labels[kind]
        if "part" in own.columns:
            seg = seg.join(own.select("record_id", "part"), ["record_id", "part"], "left_semi")
        seg = seg.select(F.lit(kind).alias("kind"), "*")
        own = own.select(F.lit(kind).alias("kind"), "record_id", "label")
        found = seg if found is None else found.unionByName(seg)
        named = own if named is None else named.unionByName(own)
    # only what was found is moved, and repeated rows repeat it exactly
    facts = F.struct("chars", "char_start", "char_end", "heard", "language", "confidence", *(_EVIDENCE if evidence else ()))
    seen = found.groupBy("kind", "record_id", "part", "segment_no").agg(F.max(facts).alias("s")).select("kind", "record_id", "part", "segment_no", "s.*")
    return materialize(seen, "language-segments"), named


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose label is missing, no language or wrong, or whose text is in several; a row for each language of the text."""
    seen, named = read_all(spark, sf_dir, evidence=False)
    parts = seen.groupBy("kind", "record_id", "part").agg(F.max("chars").alias("chars"))
    long = parts.groupBy("kind", "record_id").agg(F.sum("chars").alias("chars")).where(F.col("chars") >= MIN_TEXT)
    runs = seen.groupBy("kind", "record_id", "language").agg(F.max("heard").alias("run")).where(F.col("run") >= MIN_RUN)
    sets = runs.groupBy("kind", "record_id").agg(F.collect_set("language").alias("langs")).join(long, ["kind", "record_id"], "left_semi")
    code = label_language(F.col("label"))
    cases = sets.join(named, ["kind", "record_id"]).where(code.isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce(code, F.lit(""))))
    return cases.select("kind", "record_id", F.explode("langs").alias("lang")).distinct()


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its language and a confidence; both null where it has no text with words.

    The probabilities of all positions of the record's texts are pooled: the
    language is the one that gets most, the confidence its share. Of equal
    ones the first in order counts.
    """
    seen, named = read_all(spark, sf_dir)
    # rounded once summed, so that the order of the parts doesn't show
    sums = seen.groupBy("kind", "record_id").agg(*[F.round(F.sum(c), 3).alias(c) for c in _EVIDENCE])
    best = F.greatest(*_EVIDENCE)
    code = F.coalesce(*[F.when(F.col(c) == best, F.lit(x)) for c, x in zip(_EVIDENCE, LANGUAGES)])
    total = sum((F.col(c) for c in _EVIDENCE[1:]), F.col(_EVIDENCE[0]))
    pooled = sums.select("kind", "record_id", F.when(total > 0, code).alias("language"), F.when(total > 0, F.round(best / total, 6)).alias("confidence"))
    return named.distinct().join(pooled, ["kind", "record_id"], "left").select("kind", "record_id", "label", "language", "confidence")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text, with its language and a confidence; ``part`` is the chunk or the version."""
    return read_all(spark, sf_dir, evidence=False)[0].select("kind", "record_id", "part", "segment_no", "char_start", "char_end", "language", "confidence")


QUERIES = {"p1_found": p1_found, "p1_languages": p1_languages, "p1_segments": p1_segments}
SQL: dict = {}
