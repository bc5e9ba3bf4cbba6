"""Interval joins by bins, and joins that check their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import is_valid_primary_key


def interval_join(points: DataFrame, point: str, spans: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points with each span ``[low, high)`` that holds them, by an equi-join on bins of ``width``.

    A span is copied to each bin it touches; the bound is then checked.  Unlike
    a bare range condition this never becomes a nested loop.
    """
    binned = spans.where(F.col(high) > F.col(low)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    asked = points.withColumn("_bin", F.floor(F.col(point) / width))
    return asked.join(binned, "_bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")


def validated_left_join(left: DataFrame, right: DataFrame, on: list[str], validate: str = "many_to_one") -> DataFrame:
    """Left join that raises unless keys are unique on the right (and on the left for ``one_to_one``)."""
    sides = {"many_to_one": [right], "one_to_one": [left, right]}[validate]
    for side in sides:
        if side.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"Merge keys {on} are not unique: {validate}")
    return left.join(right, on, "left")


def membership_flag(df: DataFrame, column: str, other: DataFrame, other_column: str, out: str = "found") -> DataFrame:
    """``df`` with 1 where the value occurs in the other table, else 0."""
    keys = other.select(F.col(other_column).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return df.join(keys, column, "left").withColumn(out, F.coalesce("_hit", F.lit(0))).drop("_hit")


def lookup_with_default(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default, out: str) -> DataFrame:
    """``df`` with the looked-up value (the table's first by value) or a default."""
    one = table.groupBy(F.col(table_key).alias(key)).agg(F.min(value).alias(out))
    return df.join(one, key, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def positional_join(left: DataFrame, right: DataFrame, on: str = "row_id") -> DataFrame:
    """Inner join of two tables by their explicit row numbers."""
    return left.join(right, on)


__all__ = ["interval_join", "is_valid_primary_key", "lookup_with_default", "membership_flag", "positional_join", "validated_left_join"]
