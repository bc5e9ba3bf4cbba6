"""Model registry: lookups, names and checkpoints."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Abbreviations in model names.
ABBREVIATIONS = {"ls": "Ls", "ep": "epochs", "lr": "learning_rate", "bs": "batch_size", "gac": "gradient_accumulation_steps", "mtl": "max_token_length"}
SEPARATOR = "___"
#: Signs that numbers in names are written with.
_NUMBER_SIGNS = "+-.0123456789eE"
BASE_SCHEMA = "hf_name string, hf_path string, tokenizer_short_name string, max_token_scaling double"
DEFAULTS_SCHEMA = "basemodel string, seq_length_min int, seq_length_max int, learning_rate double, batch_size double, gradient_accumulation_steps double, max_token_length double"


def load_table(spark: SparkSession, path: str, schema: str, sheet: str | int = 0) -> DataFrame:
    """A lookup table from CSV, or from a named or numbered sheet of a sheet file where pandas can read it."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))
    return spark.read.csv(path, header=True, schema=schema)


def _parameter(part: str) -> tuple[str, int | float] | None:
    """A part's parameter: the longest abbreviation it begins with, then a number after an underscore or at once."""
    known = max((k for k in ABBREVIATIONS if part.lower().startswith(k)), key=len, default=None)
    if known is None:
        return None
    text = part[len(known) :].removeprefix("_")
    if not text or text.strip(_NUMBER_SIGNS) or text.endswith("."):
        return None
    for kind in (int, float):
        try:
            return ABBREVIATIONS[known], kind(text)
        except ValueError:
            continue
    return None


def parse_model_name(name: str) -> dict:
    """Prefix, base model, task and parameters of a name; parts that are none are left out."""
    head, rest = name.split(SEPARATOR)[:3], name.split(SEPARATOR)[3:]
    if len(head) < 3:
        raise ValueError(f"The name {name} has fewer than three parts")
    return {"prefix": head[0], "base_model": head[1], "task": head[2]} | dict(filter(None, map(_parameter, rest)))


def parsed_names(df: DataFrame, column: str = "name") -> DataFrame:
    """``df`` with the parts of model names and a map of their parameters (as text), by the rule of :func:`parse_model_name`."""
    parts = F.split(column, SEPARATOR)
    keys = sorted(ABBREVIATIONS, key=len, reverse=True)
    key = lambda p: F.coalesce(*[F.when(F.lower(p).startswith(k), k) for k in keys])
    text = lambda p: F.regexp_replace(F.substring(p, F.length(key(p)) + 1, F.length(p)), "^_", "")
    number = lambda p: (F.length(text(p)) > 0) & (F.translate(text(p), _NUMBER_SIGNS, "") == "") & ~text(p).endswith(".") & text(p).try_cast("double").isNotNull()
    names = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    found = F.filter(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(1))), lambda p: F.coalesce(number(p), F.lit(False)))
    entries = F.transform(found, lambda p: F.struct(F.element_at(names, key(p)).alias("key"), text(p).alias("value")))
    return df.where(F.size(parts) >= 3).withColumns({"prefix": parts[0], "base_model": parts[1], "task": parts[2], "parameters": F.map_from_entries(entries)})


def model_name(prefix: str, short_name: str, dataset: str, **parameters) -> str:
    """Parts joined by the separator; parameters that are None are left out."""
    keys = {v: k for k, v in ABBREVIATIONS.items()}
    order = ("Ls", "epochs", "learning_rate", "batch_size", "gradient_accumulation_steps")
    return SEPARATOR.join([prefix, short_name, dataset, *(f"{keys[n]}_{parameters[n]}" for n in order if parameters.get(n) is not None)])


def model_name_column(prefix, short_name, dataset, **parameters):
    """The same over columns; null parameters are left out."""
    keys = {v: k for k, v in ABBREVIATIONS.items()}
    return F.concat_ws(SEPARATOR, prefix, short_name, dataset, *[F.concat(F.lit(f"{keys[n]}_"), c.cast("string")) for n, c in parameters.items()])


def training_parameters(defaults: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` rows ``(model, length)`` with the first default whose model fits and whose range holds the length.

    Models are joined by equality, so the table of defaults may have any size.
    ``defaults`` has ``pos`` for its order.  Three fields become integers; a row
    without a match keeps nulls.
    """
    hit = asked.join(defaults, (F.col("basemodel") == F.col("model")) & (F.col("seq_length_min") < F.col("length")) & (F.col("seq_length_max") >= F.col("length")), "left")
    first = hit.withColumn("_n", F.row_number().over(Window.partitionBy(*asked.columns).orderBy("pos"))).where("_n = 1")
    whole = {c: F.col(c).cast("int") for c in ("batch_size", "gradient_accumulation_steps", "max_token_length") if c in defaults.columns}
    return first.withColumns(whole).drop("_n", "basemodel", "pos")


def lookup_one(df: DataFrame, key: str, value, wanted: str):
    """One value by key; each kind of absence has its own message."""
    if key not in df.columns or wanted not in df.columns:
        raise ValueError(f"The table lacks {key} or {wanted}")
    row = df.where(F.col(key) == value).select(wanted).first()
    if row is None:
        raise ValueError(f"No entry with {key} = {value}")
    if row[0] is None:
        raise ValueError(f"{wanted} of {value} is not set")
    return row[0]


def preferred_checkpoints(df: DataFrame, group: str = "model_directory", checkpoint: str = "checkpoint") -> DataFrame:
    """For each model its checkpoint 0, else its largest."""
    order = Window.partitionBy(group).orderBy((F.col(checkpoint) == 0).desc(), F.col(checkpoint).desc(), *[c for c in ("checkpoint_path",) if c in df.columns])
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def register_models(spark: SparkSession, root: str) -> DataFrame:
    """A row for each checkpoint under the model folders of ``root`` whose names can be parsed."""
    top = Path(root)
    rows = []
    for folder in sorted(p for p in top.iterdir() if p.is_dir()) if top.is_dir() else []:
        try:
            facts = parse_model_name(folder.name)
        except ValueError:
            continue
        found = sorted(p for p in folder.iterdir() if re.fullmatch(r"checkpoint-\d+", p.name))
        rows += [(facts["prefix"], facts["base_model"], facts["task"], {k: str(v) for k, v in facts.items()}, int(p.name.split("-")[1]), str(p), str(folder)) for p in found]
    if not rows:
        raise ValueError(f"There are no models in {root}")
    return spark.createDataFrame(rows, "prefix string, base_model string, task string, parameters map<string,string>, checkpoint int, checkpoint_path string, model_directory string")


def latest_checkpoint(name: str, root: str) -> tuple[bool, str | None, int | None]:
    """Whether the model has checkpoints, and the one to use: 0 stands for the final one."""
    folder = Path(root) / name
    found = [int(p.name.split("-")[1]) for p in folder.iterdir() if re.fullmatch(r"checkpoint-\d+", p.name) and any(p.iterdir())] if folder.is_dir() else []
    if not found:
        return False, None, None
    best = 0 if 0 in found else max(found)
    return True, str(folder / f"checkpoint-{best}"), best


def iteration_offset(batch_size: int, steps: int, rows: int, gpus: int = 1, accumulation: int = 1) -> int:
    """The row where training goes on after so many steps."""
    return gpus * accumulation * batch_size * steps % rows


def kmer_and_shift(name: str) -> tuple[int, int]:
    """K-mer and shift of a model, from its name or its size's usual setting."""
    usual = {"mini-c": (1, 1), "mini-long": (6, 2), "mini": (6, 1)}  # Fixed values
    if m := re.search(r"k(\d+)s(\d+)", name):
        return int(m[1]), int(m[2])
    for part, setting in usual.items():
        if name.endswith(part):
            return setting
    raise ValueError(f"The name {name} tells no k-mer and shift")
