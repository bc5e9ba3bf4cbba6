"""Helpers shared by the training-data operators: the driver's tables, and staged tables by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..staging import CHECKPOINT_KEY, drop_staged, scratch, shared_dir, stage


#: Rows of texts in an Arrow batch where a table is staged.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark only (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; after each task the worker, which lives on, gives back the memory that Arrow would keep."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's own measure of how finely data of this size is dealt."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


__all__ = ["ARROW_ROWS", "CHECKPOINT_KEY", "drop_staged", "released", "scratch", "shared_dir", "shuffle_partitions", "stage", "table"]
