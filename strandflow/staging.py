"""Tables written to the folder that all executors share, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of a staged table that a task holds before it writes them.
ROW_GROUP = 32 << 20
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SCOPES: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a folder is made on one machine (tests) and
    the setting is filled in, so later calls agree on it; a cluster without the
    setting raises, since its executors share no folder of their own.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="strandflow-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; what is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    files, where = _hadoop(spark, path)
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    return path


@contextmanager
def _arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    before = spark.conf.get(_ARROW_ROWS)
    if rows is not None:
        spark.conf.set(_ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def stage(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that were running,
    never the work that made ``df``, and values such as
    ``monotonically_increasing_id`` are fixed from here on.  The files go by
    :func:`drop_staged`, at the latest when the session ends.  ``arrow_rows``
    bounds the rows of an Arrow batch while the table is made, since the JVM
    holds whole batches outside its heap.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with _arrow_batches(spark, arrow_rows):
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for made in _SCOPES[-1:]:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Drop the tables staged within the block when it ends; yields their list, from which those to keep can be taken."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        for table_ in made:
            drop_staged(table_)


def drop_staged(df: DataFrame) -> None:
    """Delete the folder behind a table that :func:`stage` returned and nothing will read again."""
    files, where = _hadoop(df.sparkSession, df._staged_at)
    files.delete(where, True)
    files.cancelDeleteOnExit(where)
