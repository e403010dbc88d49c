"""A filter of words of bounded size: tells which words can't be in a set, however large the set is.

Built on the cluster as a bitmap from Spark's own 64-bit hash of strings and
asked in Python by the same hash. Words of the set always pass; of the others
the fewer pass the larger the filter. What passes is to be joined with the set
itself, so the filter saves a shuffle and never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each word, and the bounds of the whole: 8 KB to 8 MB.
BITS_A_WORD, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
PROBES = 3
_LOW = 0xFFFFFFFF
#: Bits in one bitmap of ``bitmap_construct_agg``; fixed value.
_BUCKET = 32_768


@dataclass
class WordFilter:
    bits: np.ndarray  # uint8
    size: int

    def may_have(self, word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        low, high = h & _LOW, h >> 32
        for i in range(PROBES):
            at = (low + i * high) % self.size
            if not self.bits[at >> 3] & (1 << (at & 7)):
                return False
        return True


def word_filter(words: DataFrame, col: str, bits_a_word: int = BITS_A_WORD) -> WordFilter:
    """The filter of a column's words; null words don't count. At most ``MOST_BITS / 8`` bytes come to the driver."""
    want = max(1, words.count()) * bits_a_word
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (want - 1).bit_length()))
    h = F.xxhash64(col)
    low, high = h.bitwiseAND(F.lit(_LOW).cast("long")), F.shiftrightunsigned(h, 32)
    at = words.where(F.col(col).isNotNull()).select(F.explode(F.array(*[F.pmod(low + F.lit(i).cast("long") * high, F.lit(size).cast("long")) for i in range(PROBES)])).alias("at"))
    # positions of a bitmap count from 1
    maps = at.select((F.col("at") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in maps.collect():
        start = (r["b"] - 1) * _BUCKET // 8
        bits[start : start + _BUCKET // 8] |= np.frombuffer(r["m"], dtype=np.uint8)
    return WordFilter(bits, size)
