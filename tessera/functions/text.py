"""Text functions as column expressions; only what Spark can't express is an Arrow function."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITE = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]"
#: Words that carry no meaning in a query; fixed values.
STOP_WORDS = (
    "the", "and", "or", "of", "to", "in", "a", "an", "is", "are", "with", "as", "by", "for", "from", "on", "at", "be", "this", "that", "into",
    "must", "shall", "will", "can", "not", "but", "all", "you", "your", "their", "they", "them", "his", "her", "its",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; within a lambda an expression would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_newline(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, 1 at least; null for null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long"))


def chunks(c: Column, size: int = 1800, overlap: int = 250) -> Column:
    """Windows of ``size`` characters, each ``overlap`` back from the last one's end, stripped, with exact offsets.

    An array of ``(chunk_index, char_start, char_end, content)``; windows of
    white space only are left out and not counted. Null for null.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size and not negative")
    step = size - overlap

    def cut(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(t) - size) / step).cast("int")))
        raw = F.transform(starts, lambda k: F.struct((k * step).alias("s"), F.substring(t, (k * step + 1).cast("int"), F.lit(size)).alias("w")))
        return F.transform(
            raw,
            lambda r: F.struct(
                (r["s"] + F.length(r["w"]) - F.length(F.regexp_replace(r["w"], rf"^{WHITE}+", ""))).cast("long").alias("char_start"),
                strip(r["w"]).alias("content"),
            ),
        )

    full = F.filter(let(one_newline(c), cut), lambda r: F.length(r["content"]) > 0)
    return F.when(c.isNotNull(), F.transform(full, lambda r, i: F.struct(i.cast("int").alias("chunk_index"), r["char_start"].alias("char_start"), (r["char_start"] + F.length(r["content"])).cast("long").alias("char_end"), r["content"].alias("content"))))


def terms(c: Column) -> Column:
    """Query terms: words of letters, digits, hyphens and apostrophes, lower case, three at least, no stop words, each once."""
    found = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_à-ÿ'\-]+"), 0), lambda w: F.regexp_replace(w, "^'+|'+$", ""))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+")), F.lit(0))


def ngrams(tokens: Column, n: int = 3) -> Column:
    """All runs of ``n`` tokens, joined by blanks, each as often as it stands there; empty if there are fewer."""

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, n), " "))

    return let(tokens, runs)


def shingles(c: Column, n: int = 5) -> Column:
    """The distinct runs of ``n`` words; the whole as one if there are fewer but some."""

    def runs(w: Column) -> Column:
        few = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) >= n, F.array_distinct(ngrams(w, n))).otherwise(few)

    return let(words(c), runs)


def paragraphs(c: Column) -> Column:
    """The parts between blank lines that aren't blank."""
    return F.filter(F.split(one_newline(c), r"\n\s*\n"), lambda p: F.length(strip(p)) > 0)


def unique_paragraphs(c: Column) -> Column:
    """The text with later repeats of a paragraph left out; only plain letters and digits tell two apart, and one without any goes."""
    parts = F.transform(paragraphs(c), lambda p: F.struct(strip(p).alias("t"), F.trim(F.regexp_replace(F.lower(p), r"[^a-z0-9]+", " ")).alias("k")))
    parts = F.filter(parts, lambda p: F.length(p["k"]) > 0)
    # the first place of each key, by one search in the list of keys
    first = let(parts, lambda ps: let(F.transform(ps, lambda p: p["k"]), lambda ks: F.filter(ps, lambda p, i: F.array_position(ks, p["k"]) == i + 1)))
    return F.array_join(F.transform(first, lambda p: p["t"]), "\n\n")


def fragment(c: Column) -> Column:
    """What stands after the last ``FIELD_FRAGMENT`` and before ``METADATA_JSON``, without two marks of the prompt; the whole text without such marks."""
    body = F.substring_index(F.substring_index(c, "FIELD_FRAGMENT", -1), "METADATA_JSON", 1)
    body = F.replace(F.replace(body, F.lit("FIELD_FRAGMENT ENDS.")), F.lit("BEGIN PROSE ONLY."))
    return unique_paragraphs(strip(body))


def sentences(c: Column) -> Column:
    """The parts after full stops, question and exclamation marks before white space; blank ones left out."""
    return F.filter(F.split(F.regexp_replace(one_newline(c), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.length(strip(s)) > 0)


def _unclosed(c: Column) -> Column:
    """Whether brackets are left open; one that closes what wasn't opened last counts for nothing."""
    marks = F.regexp_extract_all(c, F.lit(r"[\(\)\[\]\{\}]"), 0)
    pairs = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])
    step = lambda s, m: F.when(m.isin("(", "[", "{"), F.concat(s, m)).when(F.right(s, F.lit(1)) == F.try_element_at(pairs, m), F.left(s, F.length(s) - 1)).otherwise(s)
    return F.length(F.aggregate(marks, F.lit(""), step)) > 0


def truncated(c: Column) -> Column:
    """Whether a text seems to break off: nothing there, dots, open quotation or brackets, a comma or a conjunction at the end, or no stop."""
    t = strip(F.coalesce(c, F.lit("")))
    odd_quotes = F.pmod(F.length(t) - F.length(F.replace(t, F.lit('"'))), F.lit(2)) == 1
    return (
        (F.length(t) == 0)
        | t.endswith("...") | t.endswith("…") | F.contains(t, F.lit("[...]"))
        | odd_quotes
        | _unclosed(t)
        | t.rlike(r"[,;:]$")
        | t.rlike(r"(?i)\b(?:and|or|but|yet|then|while|because|for|the|of|to|with|from|into|in)$")
        | ~t.rlike(r"[.!?\"”)\]}]$")
    )


def strip_repeated_lines(c: Column, least: int = 5, longest: int = 80) -> Column:
    """The text without short lines that stand in it ``least`` times or more, unless they read like sentences."""
    content = lambda x: x.rlike(r"[.!?]$") & (F.size(F.split(x, r"\s+")) > 6)
    short = lambda x: (F.length(x) > 0) & (F.length(x) <= longest)

    def often(lines: Column) -> Column:
        # sorted, so that a line that stands n times equals the one n - 1 places on
        keys = F.array_sort(F.filter(F.transform(lines, strip), short))
        hit = let(keys, lambda ks: F.filter(ks, lambda x, i: F.get(ks, i + (least - 1)) == x))
        return F.filter(F.array_distinct(hit), lambda x: ~content(x))

    return let(F.split(one_newline(c), "\n"), lambda lines: let(often(lines), lambda bad: F.array_join(F.filter(lines, lambda x: ~F.array_contains(bad, strip(x))), "\n")))


def headings(c: Column, most: int = 200) -> Column:
    """Lines that open a chapter or stand in capitals; at most ``most``."""
    lines = F.transform(F.split(one_newline(c), "\n"), strip)
    section = r"(?i)^(chapter|chapitre|kapitel|cap[ií]tulo|capitolo|caput|book|livre|buch|libro|liber|part|partie|teil|parte)\s+[ivxlcdm0-9]+"
    hit = F.filter(lines, lambda x: x.rlike(section) | ((F.upper(x) == x) & x.rlike(r"\p{Lu}") & F.length(x).between(3, 90)))
    return F.slice(hit, 1, most)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """The composed Unicode form."""
    return s.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def clean_unicode(c: Column) -> Column:
    """Composed form without control and zero-width characters, trailing blanks, long gaps and runs of empty lines."""
    t = nfc(one_newline(c))
    t = F.regexp_replace(t, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]", "")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r" {3,}", "  ")
    return strip(F.regexp_replace(t, r"\n{4,}", "\n\n\n"))


@F.pandas_udf(StringType())
def repair_mojibake(s: pd.Series) -> pd.Series:
    """Text that was read in the wrong encoding read again, where that leaves fewer tell-tale signs."""

    def fix(x: str | None) -> str | None:
        marks = lambda t: sum(t.count(m) for m in ("Ã", "Â", "â€", "ï»¿"))
        if not x or not marks(x):
            return x
        try:
            y = x.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return x
        return y if marks(y) < marks(x) else x

    return s.map(fix)


def unaccented(c: Column) -> Column:
    """Latin letters without their accents, for names of files and addresses."""
    plain = F.translate(c, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "ß", "ss"), "œ", "oe"), "æ", "ae")


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Decomposed, and whatever isn't ASCII then left out."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))


#: Articles that a title may begin with, and signs before a subtitle; fixed values.
ARTICLES = r"^(the|a|an|le|la|les|l'|d'|du|de|des|un|une|der|die|das|den|dem|ein|eine|el|los|las|lo|il|gli|i)\s+"
SUBTITLE = r"(?s)(?:\s*[:;]\s+|\s+--\s+).*$"


def title_key(c: Column) -> Column:
    """What two titles share if they name one work: no subtitle, signs, accents, case or leading article; empty for null."""
    t = F.trim(F.lower(ascii_fold(F.coalesce(c, F.lit("")))))
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, SUBTITLE, ""), r"[^\w\s]", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(t, ARTICLES, ""))


def author_key(c: Column) -> Column:
    """What two notations of an author share: no dates, no brackets, the longer words in order."""
    t = F.lower(ascii_fold(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(F.regexp_replace(t, r"\b\d{3,4}\s*-\s*\d{0,4}\b", " "), r"\(.*?\)", " ")
    return F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(t, r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) > 1)), " ")


#: The parts of a work's key in a list of authors can't be folded within a lambda, so the names are folded together.
_NEXT_AUTHOR = "\u0001"


def work_key(title: Column, authors: Column, language: Column) -> Column:
    """``title::authors::language``: one key of a work; null without a title."""
    all_names = ascii_fold(F.array_join(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.length(a) > 0), _NEXT_AUTHOR))

    def one(a: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(F.lower(a), r"\b\d{3,4}\s*-\s*\d{0,4}\b", " "), r"\(.*?\)", " ")
        return F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(t, r"[^\w\s]", " "), r"\s+"), lambda w: F.length(w) > 1)), " ")

    names = F.array_join(F.array_sort(F.filter(F.transform(F.split(all_names, _NEXT_AUTHOR), one), lambda a: F.length(a) > 0)), "|")
    return F.when(F.length(title_key(title)) > 0, F.concat_ws("::", title_key(title), names, F.lower(F.coalesce(language, F.lit("")))))


#: Names that a record may carry, by scheme; fixed patterns.
IDENTIFIERS = (
    ("isbn", r"\b(?:isbn[:\s]*)?((?:97[89][-\s]?)?\d{1,5}[-\s]?\d{1,7}[-\s]?\d{1,7}[-\s]?[\dxX])\b"),
    ("doi", r"(?i)\b(10\.\d{4,9}/[-._;()/:a-z0-9]+)\b"),
    ("ark", r"(?i)\b(ark:/\d+/[a-z0-9]+)\b"),
    ("gutenberg", r"(?i)gutenberg\.org/(?:ebooks|files|cache/epub)/(\d+)"),
    ("oclc", r"(?i)\boclc[:\s]*(\d{5,12})\b"),
    ("lccn", r"(?i)\blccn[:\s]*([a-z]{0,3}\d{8,10})\b"),
)


def identifiers(*values: Column) -> Column:
    """``scheme:value`` of every name in the texts, in one notation, once each and sorted; an ISBN has 10 or 13 signs."""

    def named(scheme: str):
        def one(value: Column) -> Column:
            plain = F.lower(F.regexp_replace(value, r"[-\s]", ""))
            return plain if scheme == "ark" else F.concat(F.lit(f"{scheme}:"), plain)

        return one

    found = []
    for c in values:
        for scheme, pattern in IDENTIFIERS:
            each = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 1), named(scheme))
            found.append(F.filter(each, lambda x: F.length(x).isin(15, 18)) if scheme == "isbn" else each)
    return F.array_sort(F.array_distinct(F.concat(*found)))


def match_query(words_: Column) -> Column:
    """A search expression that asks for any of the words as they stand: each in quotation marks, which are doubled within."""
    return F.array_join(F.transform(F.filter(words_, lambda w: F.length(w) > 0), lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


#: Lines that enclose the text of a book of Project Gutenberg, of today and of its oldest files; fixed patterns.
PG_START = r"(?im)^\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*{3}\s*$"
PG_END = r"(?im)^\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*{3}\s*$"
PG_SMALL_PRINT = r"(?im)^\*ENDS?\*?\s*THE SMALL PRINT!.*$"
PG_WELCOME = r"(?im)^\*+\s*Welcome To The World of Free Plain Vanilla Electronic Texts\s*\*+\s*$"
PG_SEPARATOR = r"(?m)^\s*\*{3,}\s*$"
PG_FOOTER = r"(?im)^\s*(?:End of (?:the )?Project Gutenberg|End of Project Gutenberg's)\b.*$"
#: Where an old note or header may stand: so many characters from the top; fixed values.
PG_NOTE, PG_HEAD = 1200, 4000


def book_body(c: Column) -> Column:
    """``(body, boilerplate)`` of a text that may be a book of Project Gutenberg; without its marks the whole is the body. Null for null."""

    def first(t: Column, pattern: str) -> Column:
        # from 1; 0: none. By what stands before it, since the engine's own positions don't count characters but halves of some
        return F.when(t.rlike(pattern), F.length(F.split(t, pattern, 2)[0]) + 1).otherwise(0)

    def after(t: Column, pattern: str) -> Column:
        """How many characters end with the first match; 0 without one."""
        return F.when(first(t, pattern) > 0, first(t, pattern) - 1 + F.length(F.regexp_extract(t, pattern, 0))).otherwise(0)

    def names_it(t: Column) -> Column:
        return F.contains(F.lower(t), F.lit("project gutenberg"))

    def cut(t: Column) -> Column:
        marked = (first(t, PG_START) > 0) | (first(t, PG_END) > 0)
        stop = F.when(first(t, PG_END) > 0, first(t, PG_END) - 1).otherwise(F.length(t))
        begin = after(t, PG_START)
        note = F.substring(F.substring(t, begin + 1, F.greatest(stop - begin, F.lit(0))), 1, PG_NOTE)
        inner = begin + F.when(names_it(note), after(note, PG_SEPARATOR)).otherwise(0)
        head = F.substring(t, 1, PG_HEAD)
        legacy = F.greatest(after(head, PG_SMALL_PRINT), after(head, PG_WELCOME))
        old = F.when(legacy > 0, legacy).otherwise(after(head, PG_SEPARATOR))
        foot = F.when(first(t, PG_FOOTER) - 1 > old, first(t, PG_FOOTER) - 1).otherwise(F.length(t))
        plain = F.struct(F.lit(0).alias("a"), F.length(t).alias("b"))
        return F.when(marked, F.when(stop > begin, F.struct(inner.alias("a"), stop.alias("b"))).otherwise(plain)).when(names_it(head), F.struct(old.alias("a"), foot.alias("b"))).otherwise(plain)

    def parts(t: Column) -> Column:
        return let(cut(t), lambda r: F.when((r["a"] == 0) & (r["b"] == F.length(t)), F.struct(t.alias("body"), F.lit("").alias("boilerplate"))).otherwise(
            F.struct(strip(F.substring(t, r["a"] + 1, r["b"] - r["a"])).alias("body"), strip(F.concat(F.substring(t, F.lit(1), r["a"]), F.lit("\n\n"), F.substring(t, r["b"] + 1, F.length(t)))).alias("boilerplate"))
        ))

    return F.when(c.isNotNull(), let(c, parts))


def slug(c: Column, longest: int = 80) -> Column:
    t = F.regexp_replace(unaccented(F.lower(c)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, longest), "-+$", "")


def safe_filename(c: Column) -> Column:
    """A name without separators, reserved signs, leading dots and reserved words; ``file`` if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, r"[\x{0}-\x{1f}<>:\"/\\|?*]+", "_"), r"^[. ]+|[. ]+$", "")
    t = F.when(F.lower(t).rlike(r"^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"), F.concat(F.lit("_"), t)).otherwise(t)
    return F.when(F.length(t) > 0, F.substring(t, 1, 200)).otherwise(F.lit("file"))


def clip(c: Column, most: int = 900, mark: str = " [...]") -> Column:
    """One line, cut at ``most`` characters with a mark."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most)), F.lit(mark))).otherwise(t)


def occurrences(c: Column, part: str) -> Column:
    """How often a string stands in a text, not overlapping."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part)))) / len(part)).cast("int")


def year_of(c: Column) -> Column:
    """The first year from 1000 to 2029 in a text."""
    return F.try_to_number(F.regexp_extract(c, r"(?<![0-9])(1[0-9]{3}|20[0-2][0-9])(?![0-9])", 1), F.lit("9999")).cast("int")


def century_of(c: Column) -> Column:
    return (F.floor((year_of(c) - 1) / 100) + 1).cast("int")
