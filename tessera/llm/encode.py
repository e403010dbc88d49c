"""Problem 8: the ids of every text under a byte-level vocabulary, chunks encoded once.

A rolling hash over the bytes chooses where a text is cut, so equal passages of
different texts give equal chunks wherever they stand. A worker encodes each
distinct chunk once and puts the ids of a text together from its chunks.

A cut is moved to the next single blank within reach, where no piece of the
vocabulary's pattern can cross it. Where there is none (long runs without
blanks), the join is repaired: what stands around it is encoded again together,
over more and more of both chunks, until both sides agree with what they had.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import slices
from .vocab import PATTERN, ranks

WINDOW = 8
#: One position in 2 ** MASK_BITS is a cut, of blanks alone and of all bytes.
BLANK_BITS, RAW_BITS = 1, 8
REACH = 64
CACHE_CHUNKS = 300_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


@functools.cache
def encoder(name: str, folder: str | None = None) -> tiktoken.Encoding:
    """The library's encoder for a vocabulary, without special tokens."""
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})


def rolling_hash(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The hash of the ``window`` bytes that end at each position."""
    h = np.zeros(len(data), dtype=np.uint32)
    factor = np.uint32(1)
    for back in range(window):
        h[back:] += data[: len(data) - back].astype(np.uint32) * factor if back else data.astype(np.uint32)
        factor = np.uint32((int(factor) * 0x9E3779B1 + 2) & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def cut_points(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions before which to cut, and which of them need no repair; ``starts`` of the texts are among them."""
    h = rolling_hash(data)
    space = _SPACE[data]
    # a blank with other characters on both sides: one that a byte above 127 touches may be no blank of the pattern's
    plain = ~space & (data < 128)
    blank = np.zeros(len(data), dtype=bool)
    blank[1:-1] = (data[1:-1] == 32) & plain[:-2] & plain[2:]
    safe = blank.copy()
    safe[1:] &= (h[:-1] & np.uint32((1 << BLANK_BITS) - 1)) == 0
    raw = np.flatnonzero((h & np.uint32((1 << RAW_BITS) - 1)) == 1) + 1
    raw = raw[(raw < len(data))]
    # never within a character, and only where no safe cut is near
    raw = raw[(data[raw] & 0xC0) != 0x80]
    near = np.cumsum(safe)
    low, high = near[np.maximum(raw - REACH, 0)], near[np.minimum(raw + REACH, len(data) - 1)]
    raw = raw[low == high]
    is_safe = np.zeros(len(data) + 1, dtype=np.int8)
    is_safe[raw] = 1
    is_safe[np.flatnonzero(safe)] = 2
    is_safe[starts[starts <= len(data)]] = 3
    cuts = np.flatnonzero(is_safe[: len(data)])
    return cuts, is_safe[cuts] > 1


class ChunkEncoder:
    """Ids of texts by way of chunks that are kept between batches."""

    def __init__(self, enc: tiktoken.Encoding) -> None:
        self.enc = enc
        self.seen: dict[str, np.ndarray] = {}

    def chunk(self, text: str) -> np.ndarray:
        ids = self.seen.get(text)
        if ids is None:
            if len(self.seen) >= CACHE_CHUNKS:
                self.seen.clear()
            ids = self.seen[text] = np.array(self.enc.encode_ordinary(text), dtype=np.int32)
        return ids

    def repaired(self, parts: list[str]) -> np.ndarray:
        """Ids of neighbouring chunks whose joins may lie within a piece.

        The ids around a join are encoded together over ever more tokens of
        both sides; when the outer ends come out as they were, and would begin
        and end there in the whole as well, the join is right. If the two
        chunks are used up, they become one.
        """
        left = parts[0]
        for right in parts[1:]:
            left = self._join(left, right)
        return left if isinstance(left, np.ndarray) else self.chunk(left)

    def _join(self, left: str | np.ndarray, right: str) -> np.ndarray:
        a = left if isinstance(left, np.ndarray) else self.chunk(left)
        text_a = self.enc.decode_bytes(a.tolist())
        whole = (text_a + right.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass")
        at = len(text_a.decode("utf-8", "surrogatepass"))
        reach = 32
        while True:
            # grow to where the pattern must begin a piece: a blank between two other characters
            lo, hi = _blank_before(whole, at - reach), _blank_after(whole, at + reach)
            if lo == 0 and hi == len(whole):
                return np.array(self.enc.encode_ordinary(whole), dtype=np.int32)
            mid = self.enc.encode_ordinary(whole[lo:hi])
            head, tail = self._upto(a, len(whole[:lo].encode("utf-8", "surrogatepass"))), self._after(right, hi - at)
            if head is not None and tail is not None:
                return np.concatenate([head, np.array(mid, dtype=np.int32), tail])
            reach *= 4

    def _upto(self, ids: np.ndarray, size: int) -> np.ndarray | None:
        """The ids of the first ``size`` bytes, if one ends there."""
        ends = np.cumsum([len(self.enc.decode_single_token_bytes(int(i))) for i in ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        k = int(np.searchsorted(ends, size))
        if size == 0:
            return ids[:0]
        return ids[: k + 1] if k < len(ends) and ends[k] == size else None

    def _after(self, right: str, chars: int) -> np.ndarray | None:
        """The ids of what follows the first ``chars`` characters of a chunk, if one begins there."""
        ids = self.chunk(right)
        head = self._upto(ids, len(right[:chars].encode("utf-8", "surrogatepass")))
        return None if head is None else ids[len(head) :]

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text; empty for null and empty texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pa.concat_arrays([texts])
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base, end = int(offsets[0]), int(offsets[-1])
        n = len(texts)
        if end == base:
            return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, dtype=np.int32)), pa.array([], pa.int32()))
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[base:end]
        starts = offsets - base
        cuts, safe = cut_points(data, starts)
        bounds = np.append(cuts, len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(data))
        codes = chunks.dictionary_encode()
        parts = [self.chunk(t) for t in codes.dictionary.to_pylist()]
        index = np.asarray(codes.indices).astype(np.int64)
        if not safe.all():
            parts, index = self._mend(chunks, index, parts, safe)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        flat = np.concatenate(parts) if len(parts) else np.zeros(0, dtype=np.int32)
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        size = sizes[index]
        total = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(at[index] - total[:-1], size) + np.arange(total[-1])
        # the texts' first chunks say where their ids begin
        first = np.searchsorted(cuts, starts[:-1])
        lists = np.append(total[first], total[-1])
        return pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(flat[pick]))

    def _mend(self, chunks: pa.Array, index: np.ndarray, parts: list[np.ndarray], safe: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each run of chunks with doubtful joins becomes one part, which the run's first chunk gets and the others lose."""
        parts = [*parts, np.zeros(0, dtype=np.int32)]
        empty = len(parts) - 1
        index = index.copy()
        heads = np.flatnonzero(safe)
        for a, b in zip(heads, np.append(heads[1:], len(safe))):
            if b - a > 1:
                parts.append(self.repaired(chunks.slice(a, b - a).to_pylist()))
                index[a], index[a + 1 : b] = len(parts) - 1, empty
        return parts, index


def _is_edge(text: str, i: int) -> bool:
    return text[i] == " " and text[i - 1 : i].isascii() and not text[i - 1].isspace() and text[i + 1].isascii() and not text[i + 1].isspace()


def _blank_before(text: str, i: int) -> int:
    i = min(i, len(text) - 2)
    while i > 0:
        i = text.rfind(" ", 1, i + 1)
        if i < 0:
            return 0
        if _is_edge(text, i):
            return i
        i -= 1
    return 0


def _blank_after(text: str, i: int) -> int:
    i = max(i, 1)
    while True:
        i = text.find(" ", i, len(text) - 1)
        if i < 0:
            return len(text)
        if _is_edge(text, i):
            return i
        i += 1


@functools.cache
def chunk_encoder(name: str, folder: str | None = None) -> ChunkEncoder:
    """One for each Python worker."""
    return ChunkEncoder(encoder(name, folder))


def encode_texts(df: DataFrame, key: str, text: str, vocab: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(key, ids)``: ids of each row's text, without special tokens; an empty list for a null or an empty text.

    One pass over the rows, nothing is shuffled; repeated rows come out
    repeated.
    """
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(key), chunk_encoder(vocab, folder).encode(part.column(text))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)
