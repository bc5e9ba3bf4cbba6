"""Training tables as Parquet, and driver-side file helpers."""

from __future__ import annotations

import shutil
import urllib.request
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_training_table(rows: DataFrame, path: str, database: DataFrame | None = None, *, compression: str = "zstd", rows_per_file: int = 10_000_000) -> None:
    """Token rows (all of one width, else an error) and, beside them, a table of their origin; what is there is replaced."""
    widths = rows.agg(F.min(F.size("input_ids")), F.max(F.size("input_ids"))).first()
    if widths[0] != widths[1]:
        raise ValueError("The training table must be rectangular")
    for df, name in ((rows, "training_data"), (database, "database")):
        if df is not None:
            df.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{name}")


def load_training_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/training_data")


def save_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """One token a line, in the order of ids."""
    vocabulary.orderBy("id").select("token").coalesce(1).write.mode("overwrite").text(path)


def rows_from_values(spark: SparkSession, values: list, labels: list | None = None) -> DataFrame:
    """``(torch_id, input_ids[, labels])`` from lists of ids."""
    data = [(i, [int(x) for x in v], *([int(labels[i])] if labels is not None else [])) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "torch_id long, input_ids array<int>" + (", labels long" if labels is not None else ""))


def unzip(path: str, target: str) -> list[str]:
    """Files of an archive, extracted; names that would leave the target are refused."""
    base = Path(target).resolve()
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            if not (base / name).resolve().is_relative_to(base):
                raise ValueError(f"{name} lies outside {target}")
        z.extractall(base)
        return [str(base / n) for n in z.namelist()]


def download(url: str, target: str, name: str | None = None, *, extract: bool = False, remove: bool = False) -> str:
    """Fetch a file to a folder; optionally unzip it and delete the archive."""
    folder = Path(target)
    folder.mkdir(parents=True, exist_ok=True)
    out = folder / (name or url.rstrip("/").rsplit("/", 1)[-1])
    with urllib.request.urlopen(url) as response, out.open("wb") as f:
        shutil.copyfileobj(response, f)
    if extract:
        unzip(str(out), target)
        if remove:
            out.unlink()
    return str(out)
