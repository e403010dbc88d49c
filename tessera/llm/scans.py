"""Problem 7: damage from scanning, found and repaired.

Misread letters are found by anagram hashes. The hash of a word is the sum of
the fifth powers of its letters, so a confusion of letters (``rn`` for ``m``)
adds the same difference to the hash of whichever word it hits. The hashes of
frequent words plus the differences of the known confusions are joined with the
hashes of all words, in SQL; what meets by hash and by edit distance, and is
much rarer, is a misreading, and the best candidate its correction. A word with
a sign or digit among its letters counts if the corpus has it without.

Page numbers and specks are found as lines at the edges of pages. A line beside
a page number is a running title if it says what the book's title says, or if
it comes again at such places of the same book. Words broken over line ends are
joined by what the corpus has of the joined and of the hyphenated form.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import slices
from .wordfilter import WordFilter, word_filter

#: What is read for what; fixed values. The first is what stands in the text.
CONFUSIONS = (
    ("c", "e"), ("f", "t"), ("f", "s"), ("ſ", "s"), ("|", "i"), ("0", "o"), ("@", "a"), ("1", "l"), ("1", "i"), ("5", "s"), ("8", "b"),
    ("ii", "u"), ("cl", "d"), ("rn", "m"), ("m", "rn"), ("b", "h"), ("vv", "w"), ("h", "li"), ("ﬁ", "fi"), ("ﬂ", "fl"),
)
#: A frequent word has at least this count and this share of all words; so there are at most 1 / share of them.
MIN_COUNT, MIN_SHARE = 10, 2e-6
#: A misreading is at least so much rarer than what it was read for.
RATIO = 25
#: A misreading seen so often (a count, or a share of all words if that is more) must stand beside other damage in this share of its texts.
OFTEN, OFTEN_SHARE, BESIDE = 20, 5e-6, 0.2
#: Words of fewer letters are too easily another word: they count only where a text has other damage.
SHORT_WORD = 4
#: A running title shares so much of its words with the book's title and author, or comes so often at the edges of the book's pages.
TITLE_WORDS, TITLE_PLACES = 0.6, 3
#: Words held by a task before they are passed on, and words it remembers the classes of.
HELD_WORDS, KNOWN_WORDS = 300_000, 100_000

_WORD = re.compile(r"[^\W_]+(?:[|@]+[^\W_]+)*|(?<=[^\W_])[|@][^\W_]+")
#: What a sign or digit within a word was read for; fixed values.
_SIGNS = {"0": "o", "1": "li", "5": "s", "8": "b", "|": "il", "@": "a", "ſ": "s", "ﬁ": ("fi",), "ﬂ": ("fl",)}
_SYMBOL = re.compile(r"[^\W\d_][0158|@]+[^\W\d_]|(?<!\w)[0158@|][^\W\d_]{3,}|[^\W\d_]{3,}[015@|](?!\w)|[ſﬁﬂ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_LONG_S = re.compile("[ſﬁﬂ]")
_FOLIO = re.compile(r"\d+[a-z]{1,2}|[a-z]?\d+")
_PAGE = re.compile(r"\d{1,4}|[—–-] ?\d{1,4} ?[—–-]|\[(?:p|s|f|pag|page|seite)\.? ?\d{1,4}\]", re.I)
_NUMBERED_TITLE = re.compile(r"\d{1,4}\s{2,}(\S.*)|(\S.*?)(?:\.\s+|\s{2,})\d{1,4}")
_RULE = re.compile(r"([*\-_=~#•·.+—–])(?:\s*\1)*")
_BREAK = re.compile(r"([^\W\d_]+)([-¬­‐])[ \t]*\r?\n[ \t]*([^\W\d_]+)")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:\s[^\W\d_]){3,}(?![^\s.,;:!?…»”])")
# what a text must have for one of the above, by a faster engine
_HINTS = {
    "break": r"\pL[-¬\x{ad}‐][ \t]*\r?\n[ \t]*\pL",
    "spaced": r"(?:^|\s)\pL\s\pL\s\pL\s\pL(?:\s|[.,;:!?…»”]|$)",
    "line": r"(?m)^[ \t]*(?:\d{1,4}|[—–-] ?\d{1,4} ?[—–-]|\[\pL{1,5}\.? ?\d{1,4}\]|[^\pL\d\s][^\pL\d\r\n]*|\d{1,4}[ \t]{2,}\S[^\r\n]*|\S[^\r\n]*(?:\.[ \t]+|[ \t]{2,})\d{1,4})[ \t]*\r?$",
    "symbol": r"\pL[0158|@]+\pL|(?:^|[\s(«“\"'])[0158@|]\pL{3}|\pL{3}[015@|](?:[\s.,;:!?]|$)|[ſﬁﬂ]",
}


@functools.lru_cache(maxsize=50_000)
def words_of(raw: str) -> tuple[str, ...]:
    """The words in what stands between two blanks, in lower case; a hyphenated one as a whole as well."""
    low = raw.lower()
    found = tuple(_WORD.findall(low))
    if "-" in low and len(found) > 1:
        whole = low.strip("\"'«»“”„‘’().,;:!?¡¿…—–-")
        if whole.count("-") == len(found) - 1:
            return (*found, whole)
    return found


def anagram(word: str) -> int:
    """The sum of the fifth powers of the letters' numbers, as a number of 64 bits; the order of the letters doesn't matter."""
    return (sum((ord(c) % 997) ** 5 for c in word) + 2**63) % 2**64 - 2**63


def confusion_table() -> list[tuple[int, int, int]]:
    """``(difference, edits, confusions)`` of one confusion and of two together."""
    ones = [(anagram(a) - anagram(b), max(len(a), len(b)), 1) for a, b in CONFUSIONS]
    twos = [(x[0] + y[0], x[1] + y[1], 2) for i, x in enumerate(ones) for y in ones[i:]]
    best: dict[int, tuple[int, int, int]] = {}
    for d, edits, n in [*ones, *twos]:
        if d and (d not in best or (n, edits) < best[d][2:0:-1]):
            best[d] = (d, edits, n)
    return list(best.values())


def _coded(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words between blanks of a column, as codes, and where each text begins among them."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets)
    return flat.dictionary_encode(), offsets - offsets[0]


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(word, n, h)``: how often each word occurs, and its anagram hash. Tasks count their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, text):
                coded, _ = _coded(part.column(0))
                counts = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)).tolist()
                for raw, n in zip(coded.dictionary.to_pylist(), counts):
                    for w in words_of(raw):
                        held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held = {}
        if held:
            yield _counted(held)

    sums = df.select(text).mapInArrow(run, "word string, n long, h long")
    return sums.groupBy("word").agg(F.sum("n").alias("n"), F.first("h").alias("h"))


def _counted(held: dict[str, int]) -> pa.RecordBatch:
    words = list(held)
    return pa.RecordBatch.from_arrays([pa.array(words), pa.array(list(held.values()), pa.int64()), pa.array([anagram(w) for w in words], pa.int64())], names=["word", "n", "h"])


def corrections(counts: DataFrame, total: int) -> DataFrame:
    """``(word, n, right, n_right, confusions)``: the likeliest reading of every word that looks like a misreading.

    One confusion before two, then the more frequent word, then the one that
    sorts first. There are at most 1 / ``MIN_SHARE`` frequent words, each with
    one row for every difference; they meet the words by a shuffled join on
    the hash, since even that may be too much to send around.
    """
    least = max(MIN_COUNT, MIN_SHARE * total)
    differences = F.array(*[F.struct(F.lit(d).cast("long").alias("d"), F.lit(e).alias("edits"), F.lit(n).alias("confusions")) for d, e, n in confusion_table()])
    variants = counts.where((F.col("n") >= least) & ~F.col("word").rlike("[0-9]")).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "h", F.explode(differences).alias("c"))
    variants.select("right", "n_right", (F.col("h") + F.col("c.d")).alias("h"), "c.edits", "c.confusions").createOrReplaceTempView("tessera_variants")
    counts.where(F.length("word") >= 2).createOrReplaceTempView("tessera_words")
    pairs = counts.sparkSession.sql(
        f"""SELECT /*+ MERGE(v) */ w.word, w.n, v.right, v.n_right, v.confusions FROM tessera_words w JOIN tessera_variants v ON w.h = v.h
            WHERE w.n * {RATIO} <= v.n_right AND levenshtein(w.word, v.right) <= v.edits"""
    )
    best = F.min(F.struct("confusions", (-F.col("n_right")).alias("m"), "right"))
    return pairs.groupBy("word", "n").agg(best.alias("b")).select("word", "n", F.col("b.right").alias("right"), (-F.col("b.m")).alias("n_right"), F.col("b.confusions").alias("confusions"))


def edge_key(line: str) -> str:
    """What two lines at the edges of pages share if they say the same: their words in lower case."""
    return " ".join(_LETTERS.findall(line.lower()))


def _may_head(line: str) -> bool:
    return len(line) >= 8 and line[-1:] not in ".;:!?,]|" and any(c.isalpha() for c in line)


def page_lines(lines: list[str], titles: frozenset[str] | set[str] = frozenset()) -> tuple[set[int], set[int]]:
    """Numbers of the lines that are page numbers or running titles, and of those that are specks.

    A page number stands between other lines of the text. A bare number apart
    from both a finished paragraph and the next one heads a section, unless a
    running title follows it. A running title is one of ``titles`` (by
    :func:`edge_key`) and stands next to a page number or has one in its own
    line. Rules and asterisks that part sections are no specks.
    """
    text = [i for i, line in enumerate(lines) if line.strip()]
    pages, specks = set(), set()
    for k, i in enumerate(text):
        s = lines[i].strip()
        if not any(c.isalnum() for c in s):
            if (s == "|" or not _RULE.fullmatch(s)) and not set(s) <= set("\"'«»“”()[]"):
                specks.add(i)
        elif 0 < k < len(text) - 1:
            before, after = lines[text[k - 1]].strip(), lines[text[k + 1]].strip()
            if s.isdecimal() and len(s) <= 4:
                apart = text[k - 1] < i - 1 and text[k + 1] > i + 1 and not after[:1].islower() and not (titles and _may_head(after) and edge_key(after) in titles)
                if not (apart and (before[-1:] in ".!?:;»”\"])…" or int(s) < 100)):
                    pages.add(i)
            elif _PAGE.fullmatch(s) or titles and (m := _NUMBERED_TITLE.fullmatch(s)) and edge_key(m[1] or m[2]) in titles:
                pages.add(i)
    if titles:
        for i, near in _beside_numbers(lines, text, specks):
            if edge_key(lines[i]) in titles and near & pages:
                pages.add(i)
    return pages, specks


def _beside_numbers(lines: list[str], text: list[int], specks: set[int]) -> Iterator[tuple[int, set[int]]]:
    """Lines that may be running titles, by their place and form, with the numbers of the page numbers beside them; specks may come between."""
    for k, i in enumerate(text):
        if i not in specks and 0 < k < len(text) - 1 and _may_head(lines[i].strip()):
            near = {text[j] for j in (k - 1, k + 1)}
            if near & specks:
                near |= {text[j] for j in (k - 2, k + 2) if 0 <= j < len(text)}
            near = {p for p in near if _PAGE.fullmatch(lines[p].strip())}
            if near:
                yield i, near


def title_candidates(lines: list[str]) -> list[tuple[int, str]]:
    """``(line, key)`` of the lines that are running titles if the book's title or other pages say so."""
    text = [i for i, line in enumerate(lines) if line.strip()]
    specks = page_lines(lines)[1]
    found = [(i, edge_key(lines[i])) for i, _ in _beside_numbers(lines, text, specks)]
    for i in text[1:-1]:
        s = lines[i].strip()
        if not _PAGE.fullmatch(s) and (m := _NUMBERED_TITLE.fullmatch(s)) and _may_head(m[1] or m[2]):
            found.append((i, edge_key(m[1] or m[2])))
    return [x for x in found if x[1]]


def running_titles(candidates: DataFrame, key: str, group: str, heads: DataFrame | None) -> DataFrame:
    """``(key, word)`` of the candidates ``(key, group, word, other)`` that are running titles.

    ``heads`` has each ``group`` once with ``head``, what its title and author
    say. A book without a title has only the lines that come again.
    """
    each = candidates.distinct()
    often = each.groupBy(group, "word").agg(F.count("*").alias("places"))
    found = each.select(key, group, "word").distinct().join(often, [group, "word"])
    share = F.lit(0.0)
    if heads is not None:
        found = found.join(heads.select(group, "head"), group, "left")
        own = F.split("word", " ")
        title = F.regexp_extract_all(F.lower(F.coalesce("head", F.lit(""))), F.lit(r"\p{L}+"), 0)
        share = F.size(F.array_intersect(own, title)) / F.size(F.array_distinct(own))
    return found.where((share >= TITLE_WORDS) | (F.col("places") >= TITLE_PLACES)).select(key, "word").distinct()


def breaks(text: str) -> list[tuple[str, str, str]]:
    """``(left, sign, right)`` of each word broken over a line end, in lower case."""
    return [(a.lower(), sign, b.lower()) for a, sign, b in _BREAK.findall(text)]


def signed_words(text: str) -> list[str]:
    """Words that have a digit or sign in the place of a letter. Folio numbers have none."""
    return [w for w in re.findall(r"[\w|@]+", text.lower()) if not w.isalpha() and not _FOLIO.fullmatch(w) and _SYMBOL.search(w) or _LONG_S.search(w)]


def without_signs(word: str) -> set[str]:
    """The words that a word with signs may be a misreading of; each sign is read the same throughout."""
    out = {word}
    for sign, letters in _SIGNS.items():
        if sign in word:
            out = {w.replace(sign, x) for w in out for x in letters}
    return {w for w in out if w.isalpha()}


def evidence(df: DataFrame, key: str, text: str, group: str, wrong: WordFilter) -> DataFrame:
    """``(key, group, kind, word, other)``: what speaks for damage in each text.

    ``hard``: page numbers, specks, spaced words, line breaks by a sign that
    is never a plain hyphen. ``title``: a line that may be a running title,
    and its place. ``sign``: a word with a sign, and what it may be without.
    ``break``: a word broken by a hyphen, joined and as it would be if the
    hyphen belonged to it. ``word``: a word that passes the filter of
    misreadings. Texts without any come out without a row.
    """
    shared = df.sparkSession.sparkContext.broadcast(wrong)  # 8 MB at most
    kind, group_kind = (df.schema[c].dataType.simpleString() for c in (key, group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in slices(batch, text):
                column = pc.fill_null(part.column(text).cast(pa.large_string()), "")
                rows: list[tuple[int, str, str | None, str | None]] = []
                hint = {k: np.asarray(pc.match_substring_regex(column, v)) for k, v in _HINTS.items()}
                hard = np.zeros(len(column), dtype=bool)
                for i in np.flatnonzero(hint["break"] | hint["spaced"] | hint["line"] | hint["symbol"]).tolist():
                    t = column[i].as_py()
                    if hint["line"][i]:
                        lines = t.splitlines()
                        hard[i] = any(page_lines(lines))
                        rows += [(i, "title", k, str(at)) for at, k in title_candidates(lines)]
                    if hint["spaced"][i] and not hard[i]:
                        hard[i] = bool(_SPACED.search(t))
                    if hint["symbol"][i]:
                        rows += [(i, "sign", w, x) for w in signed_words(t) for x in without_signs(w)]
                    if hint["break"][i]:
                        for a, sign, b in breaks(t):
                            if sign != "-":
                                hard[i] = True
                            else:
                                rows.append((i, "break", a + b, f"{a}-{b}"))
                rows += [(i, "hard", None, None) for i in np.flatnonzero(hard).tolist()]
                coded, starts = _coded(column)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                doubtful = []
                for raw in coded.dictionary.to_pylist():
                    found = known.get(raw)
                    if found is None:
                        found = known[raw] = tuple(w for w in words_of.__wrapped__(raw) if len(w) > 1 and shared.value.may_have(w))
                    doubtful.append(found)
                flag = np.fromiter(map(bool, doubtful), dtype=bool, count=len(doubtful))
                codes = np.asarray(coded.indices)
                at = np.flatnonzero(flag[codes]) if len(codes) else np.zeros(0, np.int64)
                owner = np.searchsorted(starts, at, side="right") - 1
                rows += [(i, "word", w, None) for i, c in set(zip(owner.tolist(), codes[at].tolist())) for w in doubtful[c]]
                if rows:
                    index, kinds, left, right = zip(*rows)
                    pick = pa.array(index)
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pick), part.column(group).take(pick), pa.array(kinds), pa.array(left, pa.string()), pa.array(right, pa.string())], names=[key, group, "kind", "word", "other"])

    return df.select(key, group, text).mapInArrow(run, f"{key} {kind}, {group} {group_kind}, kind string, word string, other string")


def damage(df: DataFrame, key: str, text: str, group: str | None = None, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(found, fixes, joins, titles)``.

    ``found`` has the keys of the damaged texts, once each; ``fixes``
    ``(key, word, right)`` the misreadings in each; ``joins`` ``(key, word)``
    the words to be joined over line ends; ``titles`` ``(key, word)`` the
    running titles. ``group`` names the book a text is of, ``heads`` what the
    books' titles say; see :func:`running_titles`. Repeated rows change only
    the word counts. Null and empty texts have no damage.
    """
    if group is None:
        df, group = df.select(key, text, F.lit(None).cast("string").alias("_book")), "_book"
    counts = materialize(word_counts(df, text), "scan-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    wrong = materialize(corrections(counts, total), "scan-wrong")
    seen = materialize(evidence(df, key, text, group, word_filter(wrong, "word")), "scan-evidence")
    titles = materialize(running_titles(seen.where("kind = 'title'").select(key, group, "word", "other"), key, group, heads), "scan-titles")
    of = counts.select(F.col("word").alias("w"), F.col("n").alias("c"))

    # words with signs: whatever the corpus has without them, the most frequent first
    signed = seen.where("kind = 'sign'").select(key, "word", "other").distinct().join(of.withColumnsRenamed({"w": "other", "c": "n_right"}), "other")
    signs = materialize(signed.groupBy(key, "word").agg(F.max(F.struct("n_right", "other")).alias("b")).select(key, "word", F.col("b.other").alias("right")), "scan-signs")
    hard = seen.where("kind = 'hard'").select(key).unionByName(titles.select(key)).unionByName(signs.select(key)).distinct()

    # hyphens: the joined form against the hyphenated one; where the corpus has neither, a break is taken as one
    broken = seen.where("kind = 'break'").select(key, "word", "other").distinct()
    judged = broken.join(of.withColumnsRenamed({"w": "word", "c": "n_joined"}), "word", "left").join(of.withColumnsRenamed({"w": "other", "c": "n_hyphen"}), "other", "left")
    joins = judged.where("coalesce(n_joined, 0) >= coalesce(n_hyphen, 0)").select(key, "word")

    # misreadings: those seen often must keep company with other damage, short ones in each text
    hits = seen.where("kind = 'word'").select(key, "word").distinct().join(wrong, "word")
    beside = hard.unionByName(joins.select(key)).distinct().withColumn("_beside", F.lit(1))
    hits = materialize(hits.join(beside, key, "left").select(key, "word", "n", "right", "n_right", "_beside"), "scan-hits")
    share = hits.groupBy("word").agg((F.count("_beside") / F.count("*")).alias("share"))
    often = F.col("n") >= F.greatest(F.lit(float(OFTEN)), F.lit(OFTEN_SHARE * total))
    counted = F.when(F.length("word") < SHORT_WORD, F.col("_beside").isNotNull() & (F.col("share") >= BESIDE)).otherwise(~often | (F.col("share") >= BESIDE))
    fixes = hits.join(share, "word").where(counted).select(key, "word", "right").unionByName(signs.join(wrong.select("word"), "word", "left_anti").select(key, "word", "right"))
    found = hard.unionByName(joins.select(key)).unionByName(fixes.select(key)).distinct()
    return found, fixes, joins, titles


def _cased(model: str, word: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word[:1].upper() + word[1:] if model[:1].isupper() else word


def repair(text: str, fixes: dict[str, str], joins: set[str], titles: set[str] = frozenset()) -> str:
    """The text in continuous paragraphs, without what stands at pages' edges, with words whole and read right."""
    breaks_by = "\r\n" if "\r\n" in text else "\n"
    lines = text.splitlines()
    pages, specks = page_lines(lines, titles)
    gone = pages | specks
    kept: list[str] = []
    for i, line in enumerate(lines):
        if i in gone:
            continue
        blank = not line.strip()
        # the blank lines around a page's edge are the printer's, unless a paragraph ends there
        if blank and any(j in gone for j in (i - 1, i + 1)) and kept and kept[-1].strip() and kept[-1].rstrip()[-1:] not in ".!?:;»”\"":
            continue
        kept.append(line.rstrip())
    out = "\n".join(kept)
    out = re.sub(r"[¬­‐][ \t]*\n[ \t]*", "", out)
    out = re.sub(r"([^\W\d_]+)-[ \t]*\n[ \t]*([^\W\d_]+)", lambda m: m[1] + ("" if (m[1] + m[2]).lower() in joins else "-") + m[2], out)
    out = _SPACED.sub(lambda m: re.sub(r"\s", "", m[0]), out)
    if fixes:
        out = re.sub(r"[\w|@]+", lambda m: _cased(m[0], fixes[m[0].lower()]) if m[0].lower() in fixes else m[0], out)
    paragraphs = re.split(r"\n[ \t]*\n\s*", out)
    return (breaks_by * 2).join(re.sub(r"[ \t]*\n[ \t]*", " ", p) for p in paragraphs)


def repaired(df: DataFrame, key: str, text: str, group: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """``(key, text, damaged)``: damaged texts repaired, all others as they are.

    Rows must have been made unique by ``key``. Each text's own corrections go
    with it, so no table of all corrections is sent around.
    """
    found, fixes, joins, titles = damage(df, key, text, group, heads)
    per_text = fixes.groupBy(key).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "right")))).alias("_fixes"))
    sets = joins.select(key, "word", F.lit(True).alias("j")).unionByName(titles.select(key, "word", F.lit(False).alias("j"))).groupBy(key)
    sets = sets.agg(F.collect_set(F.when(F.col("j"), F.col("word"))).alias("_joins"), F.collect_set(F.when(~F.col("j"), F.col("word"))).alias("_titles"))
    both = df.select(key, text).join(found.withColumn("damaged", F.lit(True)), key, "left").join(per_text, key, "left").join(sets, key, "left")

    @F.pandas_udf("string")
    def fix(texts: pd.Series, fixes: pd.Series, joins: pd.Series, titles: pd.Series) -> pd.Series:
        some = lambda x: set() if x is None else set(x)
        return pd.Series([repair(t, dict(f) if f is not None else {}, some(j), some(h)) for t, f, j, h in zip(texts, fixes, joins, titles)])

    bad = both.where("damaged").select(key, fix(text, "_fixes", "_joins", "_titles").alias(text), "damaged")
    return both.where("damaged is null").select(key, text, F.lit(False).alias("damaged")).unionByName(bad)
