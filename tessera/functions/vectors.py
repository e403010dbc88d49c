"""Vectors as arrays of numbers: all arithmetic in double and within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The sum of products in the order of the elements; both of one length."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 if a vector is missing, empty, zero, or not as long as the other."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    length = norm(a) * norm(b)
    return F.when(ok & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def mean_vector(df, keys: list[str], vector: str):
    """``keys`` and ``mean``: the element-wise mean of each group's vectors.

    Elements are summed by position, so a group of any size is combined before
    the shuffle and never gathered. Vectors of another length than the group's
    longest count only where they have elements; null and empty ones don't count.
    """
    parts = df.select(*keys, F.posexplode(as_double(F.col(vector))).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(*keys, F.transform("p", lambda s: s["x"]).alias("mean"))


def hamming(a: Column, b: Column) -> Column:
    """How many bits of two 64-bit numbers differ."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def agreement(a: Column, b: Column) -> Column:
    """The share of equal positions of two signatures of one length."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def divergence(a: Column, b: Column) -> Column:
    """Half the sum of absolute differences of two maps of shares; a missing key counts as 0."""
    gaps = F.map_zip_with(a, b, lambda _, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    return F.aggregate(F.map_values(gaps), F.lit(0.0), lambda s, x: s + x) / 2
