"""Problem 5: how many tokens each text has under a public vocabulary.

A text is cut into pieces by the vocabulary's pattern; a piece's symbols are a
linked list, merged by a priority queue (see :mod:`.vocab`), and those that
survive are counted. Pieces repeat, so each distinct one is merged once for
each Python worker and then counted by its frequency; cutting and looking up
run over whole Arrow columns.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .vocab import PIECES, default_dir, merged, ranks

#: Distinct words kept by a worker; beyond that it starts afresh, which costs time and nothing else.
CACHE_WORDS = 500_000
#: Whatever white space isn't a single blank or at most two line feeds between other characters.
ODD_SPACE = r"[\t\r\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n\n|[ \n]\z"
ANY_SPACE = r"[\t\n\r\x{b}\x{c}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000} ]+"
#: Rows looked at together: bounds the memory of a worker.
SLICE_CHARS = 8_000_000


def byte_count(folder: str | None, name: str):
    """Number of symbols of a string for a byte-level vocabulary, by pieces."""
    rank = ranks(name, folder)
    seen: dict[str, int] = {}

    def count(text: str) -> int:
        total = 0
        for piece in PIECES.findall(text):
            n = seen.get(piece)
            if n is None:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                n = seen[piece] = len(merged(piece.encode("utf-8", "surrogatepass"), rank))
            total += n
        return total

    return count


class WordCounter:
    """Counts of whole texts from counts of words, where the vocabulary never joins across a blank."""

    def __init__(self, first, later, line, whole, free: bool = False) -> None:
        """Counts of a word that opens a text, that follows a blank, that follows a line feed, and of any text.

        ``free``: white space only parts words, so that any of it may stand for a blank.
        """
        self.first, self.later, self.line, self.whole, self.free = first, later, line, whole, free
        self.seen: dict[str, int] = {}

    def word(self, w: str) -> int:
        n = self.seen.get(w)
        if n is None:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            n = self.first(w[1:]) if w[:1] == "\x02" else self.line(w[1:]) if w[:1] == "\n" else self.later(w)
            self.seen[w] = n
        return n

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; 0 for null and empty ones."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out = np.zeros(len(texts), dtype=np.int64)
        if self.free:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, ANY_SPACE, " "), " ")
        odd = pc.or_(pc.match_substring_regex(texts, ODD_SPACE), pc.match_substring_regex(texts, "[\x02]|^[ \n]|\\A\\z"))
        odd = np.asarray(odd)
        for i in np.flatnonzero(odd):
            out[i] = self.whole(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        if len(plain):
            # a blank before each line feed, so that one split finds both
            some = pc.binary_join_element_wise(pa.scalar("\x02", pa.large_string()), pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), pa.scalar("", pa.large_string()))
            parts = pc.split_pattern(some, " ")
            words = parts.flatten().dictionary_encode()
            counts = np.fromiter(map(self.word, words.dictionary.to_pylist()), dtype=np.int64, count=len(words.dictionary))
            each = counts[np.asarray(words.indices)]
            starts = np.asarray(parts.offsets)[:-1]
            out[plain] = np.add.reduceat(each, starts - parts.offsets[0].as_py())
        return out


@functools.cache
def counter(name: str, folder: str | None = None) -> WordCounter:
    """The counter of a vocabulary, kept once for each Python worker."""
    folder = folder or default_dir()
    if os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
        count = byte_count(folder, name)
        return WordCounter(count, lambda w: count(" " + w), lambda w: 1 + count(w), count)
    if os.path.exists(path := os.path.join(folder, f"{name}.model")):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
        # a lone line feed is its blank's sign and its own byte, so the sign is one too many
        line = lambda w: len(sp.encode("\n" + w)) - 1
        return WordCounter(count, count, line, count)
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    tk.encode_special_tokens = True
    count = lambda t: len(tk.encode(t, add_special_tokens=False))
    return WordCounter(count, count, count, count, free=True)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes together."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    bins = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def token_counts_by(df: DataFrame, text: str, vocabs: dict[str, str], folder: str | None = None) -> DataFrame:
    """``df`` without ``text``, with the tokens of it by each vocabulary; ``vocabs`` names the columns.

    Null and empty texts have 0; all other columns pass through. Nothing is
    shuffled, and the texts go to Python once for all vocabularies.
    """
    if taken := set(vocabs) & set(df.columns):
        raise ValueError(f"the input has columns of the result already: {sorted(taken)}")
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in rest], *[T.StructField(n, T.LongType()) for n in vocabs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                counts = [pa.array(counter(v, folder).count(part.column(text))) for v in vocabs.values()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], *counts], names=[*rest, *vocabs])

    return df.select(*rest, text).mapInArrow(run, schema)


def token_counts(df: DataFrame, key: str, text: str, vocab: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``df`` without ``text``, with ``n_tokens`` of it by one vocabulary; see :func:`token_counts_by`."""
    return token_counts_by(df, text, {"n_tokens": vocab}, folder)
