"""Keyed tables without a table format: insert-or-ignore, upsert, cascades, as-of and latest rows, pages, shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def total(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row with the sum of ``value``; 0 if there are no rows or only nulls."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def all_of(*predicates: Column | None) -> Column:
    """The conjunction of those given; true for none."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``existing`` and of ``new`` the first row in ``order`` of each key that isn't there yet."""
    cols = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(F.col(order), F.struct(*cols))).alias("_r")).select(*keys, "_r.*")
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``existing`` with rows of a key replaced by the last of ``new`` in ``order``, new keys added."""
    cols = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(order), F.struct(*cols))).alias("_r")).select(*keys, "_r.*")
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_keeping(existing: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """An upsert in which the columns ``keep`` of a known key stay; ``is_new`` says which keys weren't known."""
    others = [c for c in existing.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in others], F.lit(True).alias("_in_new"))
    e = existing.withColumn("_in_old", F.lit(True))
    both = e.join(n, keys, "full")
    pick = lambda c: F.when(F.col("_in_old").isNull(), F.col(f"_n_{c}")).when(F.col("_in_new").isNull() | F.lit(c in keep), F.col(c)).otherwise(F.col(f"_n_{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in others], F.col("_in_old").isNull().alias("is_new"))


def cascade(parent_keys: DataFrame, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each child table without the rows whose parent is gone; ``parent_keys`` has the keys that go, as ``key``."""
    return [df.join(parent_keys.withColumnRenamed("key", col), col, "left_anti") for df, col in children]


def as_of(states: DataFrame, key: str, time: str, order: str, cutoff: Column) -> DataFrame:
    """Each key's last state in ``order`` among those at or before ``cutoff``."""
    cols = [c for c in states.columns if c != key]
    return states.where(F.col(time) <= cutoff).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order])).alias("_r")).select(key, "_r.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the key's last right row at or before each left time; null if there is none.

    One shuffle by key and one sort: both sides are put in one order and the
    last value seen is carried on. Of right rows at one time the greatest
    value counts; null values are passed over.
    """
    r = right.groupBy(key, F.col(right_time).alias("_t")).agg(F.max(value).alias("_v")).select(key, "_t", "_v", F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_row"))
    mine = left.select(key, F.col(left_time).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.unionByName(mine).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_v").alias(value))


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int) -> DataFrame:
    """One page in a total order; the limit is kept within 1 and 500, the offset at 0 or more."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def first_per_group(df: DataFrame, group: str, order: list[Column], n: int, reason: str) -> DataFrame:
    """``df`` with ``exclusion_reason``: null for the first ``n`` of each group, ``reason`` for the others."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("exclusion_reason", F.when(rank > n, F.lit(reason)))


def shares(df: DataFrame, by: str, weight: Column, most: int) -> DataFrame:
    """``(by, weight, share)`` of the ``most`` heaviest values; the share is of all."""
    sums = df.groupBy(by).agg(F.sum(weight).alias("weight"))
    total = sums.agg(F.sum("weight").alias("_t"))
    return sums.crossJoin(F.broadcast(total)).select(by, "weight", (F.col("weight") / F.col("_t")).alias("share")).orderBy(F.desc("weight"), by).limit(most)


def nth_of_sorted(df: DataFrame, group: list[str], value: str, p: float) -> DataFrame:
    """Each group's value at position ``int(p * n)`` of its sorted values, by rank and count and without a list."""
    w = Window.partitionBy(*group)
    ranked = df.where(F.col(value).isNotNull()).select(*group, value, F.row_number().over(w.orderBy(value)).alias("_k"), F.count("*").over(w).alias("_n"))
    return ranked.where(F.col("_k") == F.least(F.col("_n"), F.floor(F.col("_n") * p) + 1)).select(*group, F.col(value).alias("value"))


def min_max(df: DataFrame, value: str, out: str, lower_is_better: bool = False) -> DataFrame:
    """The value's place between the least and the greatest of all; 1 where all are equal."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = (F.col("_hi") - F.col(value)) if lower_is_better else (F.col(value) - F.col("_lo"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(v / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def numbered_runs(df: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """``streak``: how many rows in a row weren't ``ok`` up to each row; 0 where one is."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(ok, 1).otherwise(0)).over(w)
    return df.withColumn("_i", island).withColumn("streak", F.sum(F.when(ok, 0).otherwise(1)).over(Window.partitionBy(key, "_i").orderBy(*order))).drop("_i")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn without replacement, the same for one seed whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn without replacement by weight: the greatest of ln(u) / w; weights of 0 and less are never drawn."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_003)) + 1) / 1_000_004
    return df.where(F.col(weight) > 0).orderBy((F.ln(u) / F.col(weight)).desc(), key).limit(n)
