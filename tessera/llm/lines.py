"""Problem 4: lines that one provider's texts repeat.

For each provider and line, the share of the provider's texts that hold the
line is compared with its share among all other texts by a log-likelihood
ratio. Every line that was seen is tested, for each provider that has it, and
the step-up rule over all these tests keeps the false discovery rate. The
significant lines that also meet the problem's own rule (so many texts, such a
share of them, so many letters) are the cases: removed by an anti-join, while
the other lines are put together again by position.

The texts are read once for that; from then on a line is the two hashes of its
letters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

MIN_TEXTS, MIN_SHARE, MIN_LETTERS = 5, 0.1, 20
#: At most this share of the significant lines are so by chance.
FDR = 0.1
#: Logarithms of chances are sorted into bins of this width; below the floor any number of tests is passed.
BIN, FLOOR = 0.001, -100.0


def line_key(line: Column) -> Column:
    """What two lines must share to be the same: their letters, without case, each run of others as one blank."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))


def exploded(chunks: DataFrame) -> DataFrame:
    """``(id, text_id, line_no, line)`` of chunks ``(id, text_id, content)``; lines end at LF or CRLF and count from 1."""
    return chunks.select("id", "text_id", F.posexplode(F.split("content", "\r?\n")).alias("n", "line")).select("id", "text_id", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def keyed(chunks: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """The lines that are long enough, with ``key``.

    The length is tested first, so that short lines cost no regular expression.
    """
    lines = exploded(chunks).where(F.length("line") >= min_letters).withColumn("key", line_key(F.col("line")))
    return lines.where(F.length(F.replace(F.col("key"), F.lit(" "))) >= min_letters)


def log_p(k: Column, n: Column, k0: Column, n0: Column) -> Column:
    """The logarithm of the chance of a log-likelihood ratio as large as that of ``k`` of ``n`` against ``k0`` of ``n0``.

    0 where the share inside is not the larger one. The tail of the chi-square
    distribution with one degree of freedom is erfc(sqrt(G / 2)), here by the
    well-known rational approximation, kept as a logarithm so that it can't
    underflow.
    """
    p = (k + k0) / (n + n0)
    part = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(F.lit(0.0))
    g2 = part(k, n * p) + part(n - k, n * (1 - p)) + part(k0, n0 * p) + part(n0 - k0, n0 * (1 - p))
    x = F.sqrt(F.greatest(g2, F.lit(0.0)))  # sqrt(G / 2) with G = 2 * g2
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when((n0 == 0) | (k * n0 > k0 * n), F.ln(tail) - x * x).otherwise(F.lit(0.0))


def hashed(chunks: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``(id, text_id, line_no, h, g)`` of every line long enough, written once; ``h`` and ``g`` are two hashes of its letters, 96 bits together."""
    lines = keyed(chunks, min_letters)
    return materialize(lines.select("id", "text_id", "line_no", F.xxhash64("key").alias("h"), F.hash("key").alias("g")), "lines-hashed")


def tested_lines(lines: DataFrame, providers: DataFrame, all_texts: int) -> DataFrame:
    """``(provider, h, g, texts, of_texts, bin)``: every line of every provider with its chance, as a bin of its logarithm.

    ``lines`` is from :func:`hashed`; ``providers`` has ``text_id`` and
    ``provider``, each pair once. A text without a provider counts among all
    other texts only.
    """
    size = providers.groupBy("provider").agg(F.count("*").alias("of_texts"))
    # once a text first, then once a provider: a hot line is combined before each shuffle
    held = lines.select("text_id", "h", "g").distinct().join(providers, "text_id", "left")
    counts = held.groupBy("h", "g", "provider").agg(F.count("*").alias("texts"))
    whole = F.sum("texts").over(Window.partitionBy("h", "g"))
    counts = counts.withColumn("whole", whole).where("provider is not null").join(size, "provider")
    real = lambda c: c.cast("double")
    k, n, t = F.col("texts"), F.col("of_texts"), F.col("whole")
    chance = log_p(real(k), real(n), real(t - k), real(F.lit(all_texts) - n))
    binned = F.ceil(F.greatest(chance, F.lit(FLOOR)) / BIN).cast("int")
    return materialize(counts.select("provider", "h", "g", "texts", "of_texts", binned.alias("bin")), "lines-tested")


def step_up(tested: DataFrame, fdr: float = FDR) -> int | None:
    """The highest bin whose tests all count as significant: the last one at most rank / tests * fdr; none if there is none.

    There are at most ``-FLOOR / BIN`` bins, whatever the number of tests.
    """
    bins = tested.groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()
    tests, rank, cut = sum(r["n"] for r in bins), 0, None
    for r in bins:
        rank += r["n"]
        if r["bin"] * BIN <= math.log(rank * fdr / tests):
            cut = r["bin"]
    return cut


def repeated_lines(tested: DataFrame, min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE, fdr: float = FDR) -> DataFrame:
    """``(provider, h, g)``: the lines a provider repeats in significant excess, of those that meet the rule."""
    cut = step_up(tested, fdr)
    case = (F.col("texts") >= min_texts) & (F.col("texts") >= min_share * F.col("of_texts"))
    return materialize(tested.where((F.lit(False) if cut is None else F.col("bin") <= cut) & case).select("provider", "h", "g"), "lines-found")


def places(chunks: DataFrame, providers: DataFrame, min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE, min_letters: int = MIN_LETTERS, fdr: float = FDR) -> DataFrame:
    """``(id, line_no, provider)``: each place where a line stands that its provider repeats in excess.

    ``chunks`` has ``id``, ``text_id`` and ``content``; repeated rows change
    nothing. Null and empty contents have no such line. A line that meets the
    rule but stands in all other texts as often is no excess and stays.
    """
    lines = hashed(chunks, min_letters)
    found = repeated_lines(tested_lines(lines, providers, chunks.select("text_id").distinct().count()), min_texts, min_share, fdr)
    hit = lines.join(found.select("h", "g").distinct(), ["h", "g"], "left_semi")
    return hit.join(providers, "text_id").join(found, ["provider", "h", "g"]).select("id", "line_no", "provider").distinct()


def without_lines(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """``(id, content, removed)``: chunks without the lines at the places ``found``.

    Chunks must be unique by ``id``. Those without such a line stay as they
    are. The lines of the others lose, by an anti-join, those that were found,
    and are put together again by position, each with its own line end; what
    comes last has none. A chunk that loses all its lines is empty.
    """
    drop = materialize(found.select("id", "line_no").distinct(), "lines-places")
    removed = drop.groupBy("id").agg(F.count("*").cast("int").alias("removed"))
    hit = chunks.select("id", "content").join(removed, "id", "left_semi")
    parts = F.arrays_zip(F.split("content", "\r?\n").alias("line"), F.regexp_extract_all("content", F.lit("\r?\n"), 0).alias("end"))
    lines = hit.select("id", F.posexplode(parts).alias("n", "p")).select("id", (F.col("n") + 1).cast("long").alias("line_no"), "p.line", F.coalesce("p.end", F.lit("")).alias("end"))
    kept = lines.join(drop, ["id", "line_no"], "left_anti")
    whole = kept.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "end"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x, i: F.when(i + 1 < F.size("l"), F.concat(x["line"], x["end"])).otherwise(x["line"])), "")
    clean = removed.join(whole.select("id", text.alias("content")), "id", "left").select("id", F.coalesce("content", F.lit("")).alias("content"), "removed")
    same = chunks.select("id", "content").join(removed, "id", "left_anti").select("id", "content", F.lit(0).alias("removed"))
    return same.unionByName(clean)
