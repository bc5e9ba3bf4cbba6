"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; the root is the least node of its component.

    Rounds of large-star and small-star contraction (logarithmic in practice);
    each works by a partially aggregated minimum and a join of written tables,
    whose hot keys Spark can split, so a hub is never gathered in one task.
    Rows with a null end are dropped, as are loops.
    """
    both = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    now = stage(both, "components")
    state = _state(now)
    while state[0]:
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-least")
        large = stage(ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "components-large")
        drop_staged(least)
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "components-least")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = stage(small, "components")
        for done in (now, large, least):
            drop_staged(done)
        was, state, now = state, _state(new), new
        if state == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
