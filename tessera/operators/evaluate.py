"""Deterministic scores of written fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, occurrences, paragraphs, truncated, word_count

#: Words whose density counts; fixed values.
SYMBOLS = (
    "judgment", "logos", "tawhid", "mercy", "idolatry", "apocalypse", "revelation", "sacrifice", "machine", "audit", "confession", "transcendence", "idol", "collapse", "canon", "heresy", "obedience", "censorship", "merit", "institution", "decay",
)

#: Phrases that any text might have; fixed values.
GENERIC = ("digital ashes", "ghost in the machine", "cyberspace", "vast tapestry", "ancient forces", "in the shadows")
#: How many of the last texts count for loops.
WINDOW = 20


def density(c: Column) -> Column:
    """Occurrences of the symbols for each word, times 20, 1 at most."""
    hits = sum((occurrences(F.lower(c), s) for s in SYMBOLS[1:]), occurrences(F.lower(c), SYMBOLS[0]))
    return F.when(word_count(c) > 0, F.least(F.lit(1.0), hits * 20.0 / word_count(c))).otherwise(F.lit(0.0))


def length_score(c: Column) -> Column:
    """By the number of words, in steps: best from 220 to 449."""
    n = word_count(c)
    return F.when(n < 80, 0.0).when(n < 140, 0.35).when(n < 220, 0.65).when(n < 450, 1.0).when(n < 900, 0.9).otherwise(0.75)


def structure_score(c: Column) -> Column:
    """By the number of paragraphs; nothing below 120 words."""
    p = F.coalesce(F.array_size(paragraphs(c)), F.lit(0))
    return F.when(word_count(c) < 120, 0.0).when(p >= 3, 1.0).when(p == 2, 0.65).otherwise(0.35)


def enforcement(c: Column, keywords: Column) -> Column:
    """The share of axioms (each an array of its keywords) of which a keyword stands in the text as a word; 1 without axioms."""
    low = F.lower(F.coalesce(c, F.lit("")))
    word = lambda k: F.concat(F.lit(r"(?U)\b"), F.regexp_replace(F.lower(k), r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\b"))
    named = F.filter(keywords, lambda ks: F.exists(ks, lambda k: F.rlike(low, word(k))))
    return F.when(F.coalesce(F.array_size(keywords), F.lit(0)) == 0, 1.0).otherwise(F.array_size(named) / F.array_size(keywords))


def axiom_keywords(declared: Column, statement: Column) -> Column:
    """An axiom's declared keywords; without any, the first five words of six letters or more of its statement."""
    own = F.slice(F.filter(F.regexp_extract_all(F.lower(F.coalesce(statement, F.lit(""))), F.lit("[a-z_]+"), 0), lambda w: F.length(w) >= 6), 1, 5)
    return F.when(F.coalesce(F.array_size(declared), F.lit(0)) > 0, declared).otherwise(own)


def generic(c: Column) -> Column:
    """A quarter for each of the generic phrases that stands in the text, 1 at most."""
    return F.least(F.lit(1.0), sum((F.contains(F.lower(c), F.lit(p)).cast("int") for p in GENERIC), F.lit(0)) / 4.0)


def stuffing(c: Column, labels: Column) -> Column:
    """A quarter of the labels (categories and groups) named for each 80 words, 1 at most; 0 without labels."""
    names = F.filter(F.transform(labels, lambda x: F.replace(F.lower(x), F.lit("_"), F.lit(" "))), lambda x: F.length(x) > 0)
    hits = F.size(F.filter(names, lambda x: F.contains(F.lower(c), x)))
    return F.when(labels.isNull(), 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(1.0), word_count(c) / 80.0) / 4.0))


def evaluated(df: DataFrame, text: str, response: str | None = None, labels: str | None = None, loop: str | None = None, keywords: str | None = None) -> DataFrame:
    """``df`` with ``density``, ``length_score``, ``structure``, ``cut_off``, ``generic``, ``stuffing``, ``enforcement`` and their weighted ``quality``.

    Generic phrases are looked for in the column ``response``, the whole that
    was written, if there is one. ``labels`` has the categories and groups
    that were asked for, ``loop`` what :func:`loop_penalty` takes off; without
    them nothing is taken off. ``keywords`` has those of each axiom that was
    given, an array for each; without axioms all of them count as enforced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    whole = F.coalesce(F.col(response), F.lit("")) if response else t
    named = F.col(labels) if labels else F.lit(None).cast("array<string>")
    looped = F.coalesce(F.col(loop), F.lit(0.0)) if loop else F.lit(0.0)
    out = df.withColumn("density", density(t)).withColumn("length_score", length_score(t)).withColumn("structure", structure_score(t)).withColumn("cut_off", truncated(t))
    out = out.withColumn("generic", generic(whole)).withColumn("stuffing", stuffing(t, named))
    out = out.withColumn("enforcement", enforcement(t, F.col(keywords) if keywords else F.lit(None).cast("array<array<string>>")))
    total = 0.364 * F.col("enforcement") + 0.182 * F.col("density") + 0.272 * F.col("length_score") + 0.182 * F.col("structure")
    total = total - F.when(F.col("cut_off"), 0.35).otherwise(0.0) - 0.15 * F.col("stuffing") - 0.10 * F.col("generic") - looped
    return out.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def evaluated_cycles(cycles: DataFrame) -> DataFrame:
    """The fragments of ``cycles``, evaluated with the loops among the last of them; exact repeats count once."""
    f = cycles.select("id", "fragment", "response", "created_at").distinct()
    own = f.where("fragment is not null")
    loops = loop_penalty(own, "id", "fragment", motif_counts(own.select("id", "fragment", "created_at").distinct(), "id", "created_at", "fragment", WINDOW), WINDOW)
    return evaluated(f.join(loops.groupBy("id").agg(F.max("penalty").alias("loop")), "id", "left"), "fragment", "response", loop="loop")


def motif_counts(df: DataFrame, key: str, order: str, text: str, window: int) -> DataFrame:
    """``(ngram, n)``: in how many of the last ``window`` texts each run of three words stands."""
    last = df.orderBy(F.desc(order), F.desc(key)).limit(window)
    grams = last.select(key, F.explode(F.array_distinct(ngrams(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9']+"), 0), 3))).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count("*").alias("n"))


def loop_penalty(df: DataFrame, key: str, text: str, counts: DataFrame, window: int) -> DataFrame:
    """``(key, penalty)``: 0.07 for each time a text's run of words was used too often lately, 0.35 at most."""
    least = max(1, int(0.3 * window + 0.5))
    often = counts.where(F.col("n") > least)
    grams = df.select(key, F.explode(F.array_distinct(ngrams(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9']+"), 0), 3))).alias("ngram"))
    sums = grams.join(often, "ngram").groupBy(key).agg(F.sum(F.col("n") - least).alias("excess"))
    return df.select(key).join(sums, key, "left").select(key, F.least(F.lit(0.35), 0.07 * F.coalesce("excess", F.lit(0))).alias("penalty"))
