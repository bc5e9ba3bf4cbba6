"""Taxonomy lookups over a node table and its transitive closure."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def slugify(text: str | None, max_length: int = 40) -> str:
    """Lower-case ASCII words joined by underscores; ``unknown`` if nothing is left."""
    if text is None:
        return ""
    plain = unicodedata.normalize("NFKD", str(text).strip().lower()).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")[:max_length].rstrip("_") or "unknown"


def slug(column: Column | str, max_length: int = 40) -> Column:
    """:func:`slugify` of a column; null gives ``unknown``.

    ASCII values are handled by built-in functions; only others, which may lose
    their accents, go through Python.
    """
    value = F.col(column) if isinstance(column, str) else column

    @F.pandas_udf("string")
    def run(values):  # noqa: ANN001, ANN202
        return values.map(lambda v: None if v is None else slugify(v, max_length))

    plain = F.rlike(value, F.lit(r"^[\x00-\x7F]*$"))
    words = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    short = F.regexp_replace(F.substring(words, 1, max_length), "_+$", "")
    done = F.when(value.isNull() | plain, F.coalesce(F.when(short != "", short), F.lit("unknown")))
    return F.coalesce(done, run(F.when(~plain, value)))


def taxon_tag(taxa: DataFrame, asked: DataFrame, *, name: str = "name", key: str = "taxon_id", prefix: str = "tax", max_length: int = 40) -> DataFrame:
    """``asked`` with ``tag``: prefix, id and slug of the name, ``unknown`` where the taxon is absent."""
    names = taxa.groupBy(key).agg(F.min(name).alias("_name"))
    out = asked.join(names, key, "left")
    tag = F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit("_"), slug("_name", max_length))
    return out.withColumn("tag", tag).drop("_name")


def descendants(closure: DataFrame, taxon: int) -> DataFrame:
    """``taxon`` and all below it, sorted."""
    return _with_self(closure.where(F.col("asc_taxon_id") == taxon).select(F.col("taxon_id").cast("long").alias("taxon_id")), taxon)


def ascendants(closure: DataFrame, taxon: int) -> DataFrame:
    """``taxon`` and all above it, sorted."""
    return _with_self(closure.where(F.col("taxon_id") == taxon).select(F.col("asc_taxon_id").cast("long").alias("taxon_id")), taxon)


def _with_self(found: DataFrame, taxon: int) -> DataFrame:
    own = found.sparkSession.createDataFrame([(taxon,)], "taxon_id long")
    return found.where("taxon_id is not null").unionByName(own).distinct().orderBy("taxon_id")


def transitive_closure(edges: DataFrame, child: str = "taxon_id", parent: str = "parent_id", max_depth: int = 64) -> DataFrame:
    """``(taxon_id, asc_taxon_id, depth)`` of a parent table, level by level; a null or self parent ends.

    Each level is written to the shared folder, so no plan grows with the depth.
    A ring, or a table deeper than ``max_depth``, raises.
    """
    up = stage(edges.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(child))).select(F.col(child).alias("taxon_id"), F.col(parent).alias("asc_taxon_id")), "closure-edges")
    step = up.select(F.col("taxon_id").alias("asc_taxon_id"), F.col("asc_taxon_id").alias("next"))
    level, levels = up.withColumn("depth", F.lit(1)), []
    while True:
        levels.append(level)
        further = level.join(step, "asc_taxon_id").select("taxon_id", F.col("next").alias("asc_taxon_id"), F.lit(len(levels) + 1).alias("depth"))
        level = stage(further, "closure-level")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        if len(levels) >= max_depth:
            raise ValueError(f"The table is deeper than {max_depth} levels, or has a ring")
