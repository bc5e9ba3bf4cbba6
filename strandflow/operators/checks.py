"""Validation of frames and files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_expected_columns(df: DataFrame, expected: list[str]) -> bool:
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"The following columns are missing: {missing}")
    return True


def primary_key_check(df: DataFrame, column: str) -> DataFrame:
    """One row ``(n, distinct, nulls, valid)``; counted by groups, so a hot key is only a large count."""
    check_expected_columns(df, [column])
    groups = df.groupBy(column).agg(F.count("*").alias("n"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(column).alias("distinct"), F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    return out.withColumn("valid", (F.col("nulls") == 0) & (F.col("n") == F.col("distinct")))


def is_valid_primary_key(df: DataFrame, column: str) -> bool:
    return bool(primary_key_check(df, column).first()["valid"])


def check_file_exists(path: str) -> bool:
    if not Path(path).is_file():
        raise ValueError(f"The file {path} does not exist")
    return True


def create_directory_for_filepath(path: str) -> None:
    parent = str(Path(path).parent) if path else ""
    if not path:
        raise ValueError("The path is empty")
    Path(parent).mkdir(parents=True, exist_ok=True)


def filter_short_sequences(df: DataFrame, threshold: int, column: str = "sequence") -> DataFrame:
    """Rows whose sequence has at least ``threshold`` characters; null counts as none."""
    return df.where(F.coalesce(F.length(column), F.lit(0)) >= threshold)


def select_first_n(df: DataFrame, n: int | None, order: str) -> DataFrame:
    return df if n is None else df.orderBy(order).limit(max(0, n))


def keep_columns(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Projection onto those of ``keys`` that exist, in their order."""
    return df.select(*[k for k in keys if k in df.columns])


#: Inputs of a model.
MODEL_INPUTS = ("input_ids", "attention_mask", "token_type_ids", "labels")


def model_inputs(df: DataFrame, keys: tuple[str, ...] = MODEL_INPUTS) -> DataFrame:
    return keep_columns(df, keys)
