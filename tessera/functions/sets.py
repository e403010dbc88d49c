"""Sets of word runs as numbers: their hashes, an order by rarity, and which of many sets may be alike.

Everything here is a bound or an order, so no pair of like sets is lost; what
is alike is counted over the whole sets afterwards.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counters of the table by which runs are ordered; several runs may share one, which only changes the order.
COUNTERS = 1 << 22
#: Words whose hashes a worker keeps; words and pairs that are looked at together.
CACHE, AT_ONCE, PAIRS = 500_000, 500_000, 1 << 20
#: Characters of texts that are looked through for words at once.
CHARS = 1 << 22
#: Before texts that are already lower case and parted by blanks, and signs that need it: all but Latin letters and common signs, whose classes never change.
#: Single ranges, since the JVM takes ten times as long for a class of several.
PARTED, BEYOND, DOUBTFUL = "\u0001", r"[^\x{0}-\x{24f}]", (r"[\x{250}-\x{1fff}]", r"[\x{2070}-\x{10ffff}]")
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_KNOWN = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def plain_text(text: str) -> Column:
    """A text for :func:`text_words`: as it is if Python and the JVM agree on all its letters, else its :func:`words` parted by blanks after a mark."""
    parted = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")
    beyond = (F.octet_length(text) != F.length(text)) & F.col(text).rlike(BEYOND)
    doubtful = F.startswith(F.col(text), F.lit(PARTED)) | (beyond & (F.col(text).rlike(DOUBTFUL[0]) | F.col(text).rlike(DOUBTFUL[1])))
    return F.when(doubtful, F.concat(F.lit(PARTED), parted)).otherwise(F.col(text))


def text_words(t: str | None) -> list[str]:
    """The words of what :func:`plain_text` gives."""
    if not t:
        return []
    return t[1:].split() if t.startswith(PARTED) else _WORD.findall(t.lower())


#: Of each byte whether it stands in a word, as all beyond ASCII do at first; the same of signs of two bytes; masks of the first bytes of eight.
_BYTES = np.array([c > 127 or _WORD.fullmatch(chr(c)) is not None for c in range(256)])
_SIGNS = np.array([not (0x80 <= c < 0x250 or c == 0x307) or _WORD.fullmatch(chr(c)) is not None for c in range(1 << 11)])
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


class Places:
    """Finds which words of texts stand in a list, and where there: without a string for each word, eight bytes at a time."""

    def __init__(self, listed: list[str]) -> None:
        left = [(i, t.encode("utf-8", "surrogatepass"), 0) for i, t in enumerate(listed) if t and "\0" not in t]
        self.many, self.steps = max(len(listed), 1), []
        while left:
            cut = [(i, t, before, int.from_bytes(t[:8], "little")) for i, t, before in left]
            values = np.array(sorted({v for *_, v in cut}), dtype=np.uint64)
            which = {int(v): i for i, v in enumerate(values)}
            starts = np.array(sorted({before * len(values) + which[v] for _, _, before, v in cut}), dtype=np.int64)
            number = {int(x): i for i, x in enumerate(starts)}
            place, left = np.full(len(starts), -1, dtype=np.int64), []
            for i, t, before, v in cut:
                at = number[before * len(values) + which[v]]
                if len(t) <= 8:
                    place[at] = i
                else:
                    left.append((i, t[8:], at))
            self.steps.append((values, starts, place))

    def count(self, texts: list[str | None]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """Of what :func:`plain_text` gives, by groups of texts: lengths in words, for each text the places of listed words, and how often each stands there."""
        at = 0
        while at < len(texts):
            some, n = [], 0
            while at < len(texts) and n < CHARS:
                t = texts[at] or ""
                some.append((t if t.startswith(PARTED) else t.lower()).encode())
                n, at = n + len(t), at + 1
            yield self._counted(some)

    def _counted(self, texts: list[bytes]) -> tuple[pa.Array, pa.Array, pa.Array]:
        raw = b"\n" + b"\n".join(texts) + b"\n" * 9
        b = np.frombuffer(raw, dtype=np.uint8)
        word = _BYTES[b]
        high = np.flatnonzero(b >= 0xC2)
        two, three = high[b[high] < 0xE0], high[b[high] == 0xE2]
        two = two[~_SIGNS[(b[two].astype(np.int64) & 31) << 6 | b[two + 1] & 63]]
        three = three[(b[three + 1] == 0x80) | (b[three + 1] == 0x81) & (b[three + 2] < 0xB0)]  # the signs from 2000 to 206F
        for off in (two, two + 1, three, three + 1, three + 2):
            word[off] = False
        turn = np.flatnonzero(word[1:] != word[:-1]) + 1
        start, size = turn[::2], turn[1::2] - turn[::2]
        begin = 1 + np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
        length = np.diff(np.searchsorted(start, begin))
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        place, at, state = np.full(len(start), -1, dtype=np.int64), np.arange(len(start)), np.zeros(len(start), dtype=np.int64)
        for k, (values, starts, places) in enumerate(self.steps):
            left = size[at] - 8 * k
            v = eight[start[at] + 8 * k] & _FIRST[np.minimum(left, 8)]
            i = np.minimum(np.searchsorted(values, v), len(values) - 1)
            ok = values[i] == v
            at, left, state = at[ok], left[ok], state[ok] * len(values) + i[ok]
            i = np.minimum(np.searchsorted(starts, state), len(starts) - 1)
            ok = starts[i] == state
            at, left, state = at[ok], left[ok], i[ok]
            place[at[left <= 8]] = places[state[left <= 8]]
            at, state = at[left > 8], state[left > 8]
        hit = np.flatnonzero(place >= 0)
        pair = np.sort(np.repeat(np.arange(len(texts)), length)[hit] * self.many + place[hit])
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
        text, found = np.divmod(pair[new], self.many)
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))], pa.int32())
        return pa.array(length, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(np.diff(np.r_[new, len(pair)]), pa.int64()))


def word_runs(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text its distinct runs of ``n`` words as sorted 64-bit hashes; the whole as one if there are fewer but some."""
    factor = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1) | 1) % 2**64) for i in range(n)]
    at = 0
    while at < len(texts):
        flat, ends = [], []
        while at < len(texts) and len(flat) < AT_ONCE:
            flat.extend(map(_KNOWN.__getitem__, text_words(texts[at])))
            ends.append(len(flat))
            at += 1
        if len(_KNOWN) > CACHE:
            _KNOWN.clear()
        w = np.array(flat, dtype=np.uint64)
        h = np.zeros(max(len(w) - n + 1, 0), dtype=np.uint64)
        for i in range(n):
            h += w[i : i + len(h)] * factor[i]
        h = _mixed(h)
        begin = 0
        for end in ends:
            if end - begin >= n:
                yield np.unique(h[begin : end - n + 1])
            elif end > begin:
                few = sum(int(x) * int(f) for x, f in zip(w[begin:end], factor)) + end - begin
                yield _mixed(np.array([few % 2**64], dtype=np.uint64))
            else:
                yield w[:0]
            begin = end


def counter(h: np.ndarray) -> np.ndarray:
    """The place of each hash in the table of counters."""
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of eight steps for each doubling; 0: not seen twice."""
    return np.minimum(8 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


def size_bounds(most: int, similar: float) -> list[int]:
    """The least size of each class of sizes up to ``most``, and of two more: like sets are of the same class or of neighbouring ones."""
    out = [1]
    while len(out) < 3 or out[-3] <= most:
        out.append(max(out[-1] + 1, math.floor((out[-1] - 1) / similar + 1e-9) + 1))
    return out


def width(bounds: list[int], z: int) -> int:
    """Bits of the parity maps of class ``z``: a power of two that is not below its sizes."""
    return 1 << max(6, (bounds[z + 1] - 1).bit_length())


def parities(h: np.ndarray, bits: int) -> bytes:
    """One bit for each value of the lowest bits of a hash: whether an odd number of runs has it. Two maps differ in no more bits than their sets in runs."""
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix(h: np.ndarray, rare: np.ndarray, similar: float) -> bytes:
    """Of a set in order of rarity, all but ``ceil(similar * n) - 1`` runs, cut to 32 bits; those not seen twice are left out, but take their place."""
    r = rare[counter(h)]
    order = np.lexsort((h, r))[: len(h) - math.ceil(len(h) * similar - 1e-9) + 1]
    return (h[order[r[order] > 0]] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def like_pairs(n: np.ndarray, prefixes: list[bytes], maps: np.ndarray, least: int, may_meet: Callable[[np.ndarray, np.ndarray], np.ndarray | bool], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of sets that may be alike: a run of both prefixes, sizes and parity maps that allow it, a larger one of ``least`` or more, and ``may_meet(i, j)``.

    ``maps`` has one row of bytes a set. Runs are gone through in ranges, so
    that only one range of them and ``PAIRS`` pairs are held besides the sets.
    """
    order = np.argsort(n, kind="stable")  # of two sets that meet the smaller one comes first
    lens = np.array([len(prefixes[i]) // 4 for i in order], dtype=np.int64)
    flat = np.frombuffer(b"".join(prefixes[i] for i in order), dtype=np.uint32)
    words, size = np.ascontiguousarray(maps[order]).view(np.uint64), n[order].astype(np.int64)
    owner = np.repeat(np.arange(len(order), dtype=np.int32), lens)
    parts = 1 << max(0, math.ceil(math.log2(max(len(flat), 1) / AT_ONCE)))
    found: list[np.ndarray] = []
    for part in range(parts):
        some = np.flatnonzero(flat % np.uint32(parts) == part) if parts > 1 else np.arange(len(flat))
        by = np.argsort(flat[some], kind="stable")
        t, o = flat[some][by], owner[some][by].astype(np.int64)
        begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
        end = np.repeat(np.r_[begin[1:], len(t)], np.diff(np.r_[begin, len(t)])) if len(t) else begin
        # sizes rise within a run's list, so each set meets a stretch of those after it
        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(t)])) if len(t) else begin
        scale = int(size.max()) + 2 if len(size) else 1
        rank = group * scale + size[o]
        limit = group * scale + np.minimum(np.floor(size[o] / similar + 1e-9).astype(np.int64), scale - 2)
        stop = np.minimum(np.searchsorted(rank, limit, side="right"), end)
        start = np.maximum(np.searchsorted(rank, group * scale + min(least, scale - 1)), np.arange(1, len(t) + 1))
        many = np.maximum(stop - start, 0)
        total = np.r_[0, np.cumsum(many)]
        for low in range(0, int(total[-1]), PAIRS):
            at = np.arange(low, min(low + PAIRS, int(total[-1])))
            left = np.searchsorted(total, at, side="right") - 1
            a, b = o[left], o[start[left] + at - total[left]]
            ok = np.broadcast_to(may_meet(order[a], order[b]), a.shape)
            a, b = a[ok], b[ok]
            differ = np.zeros(len(a), dtype=np.int64)
            most = np.floor((size[a] + size[b]) * ((1 - similar) / (1 + similar)) + 1e-9)
            for w in range(words.shape[1]):  # most pairs are far apart after a few words
                differ += np.bitwise_count(words[a, w] ^ words[b, w])
                if w % 4 == 3:
                    near = differ <= most
                    a, b, differ, most = a[near], b[near], differ[near], most[near]
            near = differ <= most
            found.append(np.unique(a[near] * len(order) + b[near]))
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return order[every // max(len(order), 1)], order[every % max(len(order), 1)]
