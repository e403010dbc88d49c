"""Quality and form of texts, scored from counts of their characters, words and lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import one_newline
from .language import by_function_words, declared_language

#: Thresholds of the gate; fixed values.
LIMITS = {
    "unreadable": 0.01, "mojibake": 0.002, "alpha": 0.55, "repetition": 0.35, "short_lines": 0.55, "single": 0.25, "short_text": 200,
    "navigation": 0.2, "long_form": 20_000, "shortfall": 0.02, "pdf_text": 0.8,
}
#: Parts of the names of forms that are short by nature, and what lines of web pages around a text say; fixed values.
SHORT_FORMS = (
    "manifesto", "manifeste", "declaration", "déclaration", "proclamation", "charter", "charte", "constitution", "speech", "discours", "address",
    "poem", "poetry", "poème", "sonnet", "tract", "pamphlet", "broadside", "creed", "credo", "thesis", "theses", "sermon", "letter", "lettre",
    "decree", "edict", "édit", "bull", "encyclical", "platform", "programme",
)
NAVIGATION = (
    "click here", "next page", "previous page", "table of contents", "back to top", "printer-friendly", "share this", "log in", "sign up", "cookie", "javascript",
    "page suivante", "page précédente", "retour au sommaire", "menu principal",
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def components(df: DataFrame, key: str, text: str, label: str | None = None, form: str | None = None, pdf_text: str | None = None, read_failures: str | None = None) -> DataFrame:
    """``key`` and the ratios and facts the score is made of; null texts count as empty.

    ``label`` names the column of the language label, ``form`` that of the
    document's form, ``pdf_text`` the quality of a PDF's text layer (null for
    other formats) and ``read_failures`` how many parts of an EPUB couldn't be
    read. Without a label nothing contradicts it; without a form a text is
    expected to be long. Each is a regular expression or a function of arrays
    over one text, so all of it is one projection.
    """
    t = one_newline(F.coalesce(F.col(text), F.lit("")))
    given = lambda name, kind: F.lit(None).cast(kind) if name is None else F.col(name).cast(kind)
    facts = {
        "declared": declared_language(given(label, "string")),
        "short_form": F.coalesce(F.lower(given(form, "string")).rlike("|".join(SHORT_FORMS)), F.lit(False)),
        "pdf_text": given(pdf_text, "double"),
        "read_failures": F.coalesce(given(read_failures, "long"), F.lit(0)),
    }
    base = by_function_words(df.select(key, t.alias("t"), *[c.alias(name) for name, c in facts.items()]), key, "t", "t", *facts).withColumns({"n": F.length("t"), "low": F.lower("t")})
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    # letters and signs are counted by what is left of a text: a count of matches would build an array with each
    plain = F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}_]+"), 0)
    solid = F.length(F.regexp_replace("t", r"\s+", ""))
    base = base.withColumns({"plain": plain, "lines": lines, "solid": solid}).withColumn("w", F.size("plain"))
    odd = F.regexp_count("t", F.lit(r"[\x{fffd}\x{0}-\x{8}\x{e}-\x{1f}]"))
    moji = F.regexp_count("t", F.lit("Ã|Â|â€"))
    alpha = F.length(F.regexp_replace("t", r"\P{L}+", ""))
    single = F.size(F.filter("plain", lambda x: (F.length(x) == 1) & x.rlike(r"^\p{L}$")))
    some = reduce(or_, [F.contains("low", F.lit(m)) for m in NAVIGATION])
    of_pages = F.when(some, F.size(F.filter("lines", lambda x: F.lower(x).rlike("|".join(NAVIGATION))))).otherwise(0)
    n_lines = F.size("lines")
    return base.select(
        key,
        F.col("n").alias("chars"),
        F.col("w").alias("words"),
        _ratio(odd, F.col("n")).alias("unreadable"),
        _ratio(moji, F.col("w")).alias("mojibake"),
        _ratio(alpha, F.col("solid")).alias("alpha"),
        _ratio(n_lines - F.size(F.array_distinct("lines")), n_lines).alias("repetition"),
        _ratio(F.size(F.filter("lines", lambda x: F.length(x) < 25)), n_lines).alias("short_lines"),
        _ratio(single, F.col("w")).alias("single"),
        _ratio(of_pages, n_lines).alias("navigation"),
        F.col("language").alias("detected"),
        *facts,
    )


def score(c: DataFrame) -> DataFrame:
    """``score`` from 1 downwards, and ``issues``: the names of what cost points.

    The language, the form and the format aren't judged in texts too short to score.
    """
    enough = F.col("chars") >= LIMITS["short_text"]
    shortfall = 1 - F.col("chars") / LIMITS["long_form"]
    short = F.least(F.lit(0.4), 0.5 * shortfall * shortfall)
    rules = (
        ("unreadable", F.col("unreadable") > LIMITS["unreadable"], F.least(F.lit(0.5), 20 * F.col("unreadable"))),
        ("mojibake", F.col("mojibake") > LIMITS["mojibake"], F.least(F.lit(0.4), 30 * F.col("mojibake"))),
        ("alpha", F.col("alpha") < LIMITS["alpha"], F.least(F.lit(0.4), 2 * (LIMITS["alpha"] - F.col("alpha")))),
        ("repetition", F.col("repetition") > LIMITS["repetition"], F.least(F.lit(0.35), 1.5 * (F.col("repetition") - LIMITS["repetition"]))),
        ("short_lines", F.col("short_lines") > LIMITS["short_lines"], F.least(F.lit(0.3), 1.2 * (F.col("short_lines") - LIMITS["short_lines"]))),
        ("single", F.col("single") > LIMITS["single"], F.least(F.lit(0.3), 1.5 * (F.col("single") - LIMITS["single"]))),
        ("navigation", enough & (F.col("navigation") > LIMITS["navigation"]), F.least(F.lit(0.25), F.col("navigation") - LIMITS["navigation"])),
        ("language", enough & (F.col("detected") != "unknown") & (F.col("declared") != F.col("detected")), F.lit(0.05)),
        ("short_for_form", enough & ~F.col("short_form") & (F.col("chars") < LIMITS["long_form"]) & (short > LIMITS["shortfall"]), short),
        ("pdf_text", enough & (F.col("pdf_text") < LIMITS["pdf_text"]), F.least(F.lit(0.5), 1.5 * (LIMITS["pdf_text"] - F.col("pdf_text")))),
        ("epub_reads", enough & (F.col("read_failures") > 0), F.lit(0.05)),
    )
    total = F.lit(1.0)
    for _, when, cost in rules:
        total = total - F.when(when, cost).otherwise(0.0)
    value = F.when(F.col("chars") < LIMITS["short_text"], 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return c.withColumn("score", value).withColumn("issues", F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when, _ in rules])))


@F.pandas_udf(T.DoubleType())
def char_entropy(texts: pd.Series) -> pd.Series:
    """Bits a character of each text, counted within the row; null for null and empty texts."""

    def one(t: str | None) -> float | None:
        if not t:
            return None
        n = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)[1].astype(float)
        return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())

    return texts.map(one)


def entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, entropy)``: bits a character of each text; texts without characters have no row. Nothing is shuffled."""
    return df.select(key, char_entropy(F.col(text)).alias("entropy")).where("entropy is not null")
