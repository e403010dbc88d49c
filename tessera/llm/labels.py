"""What a language label names, in any of the notations that occur."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-letter codes and the other notations of each language; fixed values.
NOTATIONS = {
    "en": ("eng", "english", "anglais", "englisch", "inglés", "inglese", "anglica"),
    "fr": ("fra", "fre", "french", "français", "francais", "französisch", "francés", "francese"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "espagnol", "spanisch", "spagnolo"),
    "it": ("ita", "italian", "italiano", "italien", "italienisch"),
    "la": ("lat", "latin", "latina", "latein", "latín", "latino"),
}


def label_language(col: Column) -> Column:
    """The two-letter code a label names; null if it names none of the known languages.

    The last part of a web address counts, and of a code with a region the
    part before it; case and blanks around don't.
    """
    tail = F.regexp_replace(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), r"^.*[/#]", "")
    main = F.regexp_replace(tail, r"[-_].*$", "")
    every = {x: code for code, names in NOTATIONS.items() for x in (code, *names)}
    table = F.create_map(*[F.lit(x) for pair in every.items() for x in pair])
    return F.try_element_at(table, main)
