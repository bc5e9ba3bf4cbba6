"""Dense numbers, running totals and hash randomness without single-partition windows over data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys in one block of a running total.
BLOCK = 1 << 8
#: Blocks in one block of blocks.
SUPER = 1 << 12
#: Modulus of the generator behind :func:`uniform`.
PRIME = (1 << 31) - 1


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its parts, of any types; the same on every run and layout."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) fixed by its integer parts, by steps modulo a prime that any engine can repeat."""
    h: Column = F.lit(0).cast("long")
    for p in parts:
        here = F.lit(p % PRIME) if isinstance(p, int) else F.pmod(p.cast("long"), F.lit(PRIME))
        h = (h + here + 1) * 48271 % PRIME
    h = (h * (h + 16807) + 1) % PRIME
    h = (h * (h + 48271) + 7) % PRIME
    return (h + (h * 69621 + 1) % PRIME / F.lit(float(PRIME))) / F.lit(float(PRIME))


def uniform_sql(*parts: str | int) -> str:
    """:func:`uniform` as SQL text."""
    h = "0::BIGINT"
    for p in parts:
        here = str(p % PRIME) if isinstance(p, int) else f"((({p}) % {PRIME} + {PRIME}) % {PRIME})"
        h = f"((({h} + {here} + 1) * 48271) % {PRIME})"
    h = f"(({h} * ({h} + 16807) + 1) % {PRIME})"
    h = f"(({h} * ({h} + 48271) + 7) % {PRIME})"
    return f"(({h} + (({h} * 69621 + 1) % {PRIME}) / {float(PRIME)!r}::DOUBLE) / {float(PRIME)!r}::DOUBLE)"


def uniform_values(*parts: np.ndarray | int) -> np.ndarray:
    """:func:`uniform` of arrays."""
    h: np.ndarray | int = 0
    for p in parts:
        h = (h + np.mod(p, PRIME) + 1) * 48271 % PRIME
    h = (h * (h + 16807) + 1) % PRIME
    h = (h * (h + 48271) + 7) % PRIME
    return (h + (h * 69621 + 1) % PRIME / float(PRIME)) / float(PRIME)


def _starts(sums: DataFrame, value: str) -> DataFrame:
    """``(_block, _start)``: of blocks with their ``value``, what all blocks before hold; summed by blocks of blocks."""
    sums = sums.withColumn("_super", F.floor(F.col("_block") / SUPER).cast("long"))
    tops = sums.groupBy("_super").agg(F.sum(value).alias("_top"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_super", F.coalesce(F.sum("_top").over(before(Window.orderBy("_super"))), F.lit(0)).alias("_from"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("_super").orderBy("_block"))), F.lit(0))
    return sums.join(tops, "_super").select("_block", (F.col("_from") + inside).alias("_start"))


def _blocked(df: DataFrame, key: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(key) / block).cast("long"))


def cumulative(df: DataFrame, key: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the running total of ``value`` up to each integer ``key``, in the order of keys.

    Keys are summed within blocks, and the blocks' totals by blocks of blocks
    (one row for ``block * SUPER`` keys in the last window), so no task sorts
    the table.  Rows are dealt to the session's shuffle partitions, however few
    bytes they have, since what follows may cost more than its bytes tell.
    """
    blocked = _blocked(df, key, block)
    starts = _starts(blocked.groupBy("_block").agg(F.sum(value).alias("_sum")), "_sum")
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    dealt = blocked.repartition(_partitions(df), "_block").withColumn("_within", F.sum(value).over(within))
    return dealt.join(starts, "_block").withColumn(out, F.col("_start") + F.col("_within")).drop("_block", "_start", "_within")


def dense_rows(df: DataFrame, key: str, order: list, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``out`` numbering all rows from 0 by the integer ``key``, then by ``order``."""
    blocked = _blocked(df, key, block)
    starts = _starts(blocked.groupBy("_block").agg(F.count("*").alias("_n")), "_n")
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(key, *order))
    dealt = blocked.repartition(_partitions(df), "_block").withColumn("_within", rank)
    return dealt.join(starts, "_block").withColumn(out, (F.col("_start") + F.col("_within") - 1).cast("long")).drop("_block", "_start", "_within")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def first_seen_codes(df: DataFrame, value: str, order: str, out: str = "code") -> DataFrame:
    """``df`` with dense codes of ``value`` in the order of first appearance."""
    firsts = df.groupBy(value).agg(F.min(order).alias("_first"))
    codes = dense_rows(firsts, "_first", [value], out).select(value, F.col(out).cast("int").alias(out))
    return df.join(codes, value, "left")


def sorted_codes(df: DataFrame, value: str, out: str = "code") -> DataFrame:
    """``df`` with dense codes of the distinct values in ascending order; nulls stay null."""
    values = df.where(F.col(value).isNotNull()).select(value).distinct()
    codes = values.select(value, (F.row_number().over(Window.orderBy(value)) - 1).cast("int").alias(out))  # classes, not rows
    return df.join(codes, value, "left")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order fixed by seed and key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
