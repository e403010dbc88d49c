"""Problem 2: cutting oversized texts at natural boundaries, with overlap.

A hierarchy of separators (section, paragraph, sentence, word, character) is
applied recursively: a stretch that fits a piece stays whole, and one too long
is cut by the next finer separator. The stretches are packed greedily up to the
limit. Each piece starts within the tail of the one before, at a boundary if
there is one; if the next stretch fits only behind a shorter tail, the tail is
as much shorter as a boundary allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1800, 250

#: Words that open a section, in the languages at hand; fixed values.
SECTIONS = "book|chapter|part|livre|chapitre|partie|buch|kapitel|teil|libro|capítulo|parte|capitolo|liber|caput|pars"
#: From coarse to fine; a cut is made at the end of a match.
LEVELS = (
    re.compile(rf"\f+|\n{{3,}}|\n+(?=#{{1,6}} |(?i:{SECTIONS})\s+[IVXLCDMivxlcdm\d]+\b)"),
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"[.!?…][\"'»”’)\]]*\s+"),
    re.compile(r"\s+"),
)
_STARTS = LEVELS[2:]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of each piece; the first starts at 0, the last ends with the text.

    No piece is longer than ``limit``; each starts at most ``overlap``
    characters before the end of the one before: at the first sentence there,
    else at the first word, else exactly ``overlap`` before. An empty text has
    one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit and not negative")
    if len(text) <= limit:
        return [(0, len(text))]
    # a piece begins at start, repeats what lies before fresh, and reaches to last
    out, start, fresh, last = [], 0, 0, 0
    todo = [(0, len(text), 0)]
    while todo:  # a stack and not recursion: stretches are pushed backwards
        a, b, level = todo.pop()
        if b - start <= limit:
            last = b
        elif last > fresh:
            out.append((start, last))
            fresh = last
            room = limit - (b - last)
            before, start = start, _restart(text, last, min(overlap, room), start + 1, exact=room >= overlap)
            if start is None:
                start = _restart(text, last, overlap, before + 1)
            todo.append((a, b, level))
        elif level == len(LEVELS):
            last = start + limit
            todo.append((last, b, level))
        else:
            cuts = [a, *(m.end() for m in LEVELS[level].finditer(text, a, b) if a < m.end() < b), b]
            todo += [(x, y, level + 1) for x, y in zip(cuts[-2::-1], cuts[:0:-1])]
    return [*out, (start, last)]


def _restart(text: str, end: int, overlap: int, floor: int, exact: bool = True) -> int | None:
    """Where a piece starts that may repeat ``overlap`` characters, ``floor`` at least; without a boundary there, just so many, or nowhere if not ``exact``."""
    low = max(end - max(overlap, 0), floor)
    if exact and low == end:
        return low
    for rule in _STARTS:
        # one character more on the left: a boundary just there counts
        for m in rule.finditer(text, low - 1, end):
            if low <= m.end() < end:
                return m.end()
    return low if exact else None


def one_break(text: Column) -> Column:
    """CRLF as one character."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, piece_no, start, end, content)`` of every row's pieces, with the columns ``keep`` of the row.

    Whoever fits the limit passes through the JVM unchanged; only the others
    go to Python. A null text gives no piece, an empty one an empty piece.
    Repeated rows must be dropped before: they would come out repeated.
    """
    own = {c: f"_keep{i}" for i, c in enumerate((key, *keep))}
    base = df.select(*[F.col(c).alias(a) for c, a in own.items()], one_break(F.col(text)).alias("text")).where("_keep0 is not null and text is not null").withColumn("n", F.length("text"))
    whole = base.where(F.col("n") <= limit).select(*own.values(), F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"), F.col("text").alias("content"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [pieces(t, limit, overlap) for t in pdf["text"]]
            out = pdf.loc[pdf.index.repeat([len(x) for x in each])].reset_index(drop=True)
            out["piece_no"] = [i for x in each for i in range(len(x))]
            out["start"], out["end"] = [a for x in each for a, _ in x], [b for x in each for _, b in x]
            out["content"] = [t[a:b] for t, a, b in zip(out["text"], out["start"], out["end"])]
            yield out.drop(columns="text")

    kinds = ", ".join(f"{a} {base.schema[a].dataType.simpleString()}" for a in own.values())
    long = base.where(F.col("n") > limit).select(*own.values(), "text").mapInPandas(cut, f"{kinds}, piece_no int, start long, end long, content string")
    return whole.unionByName(long).withColumnsRenamed({a: c for c, a in own.items()})
