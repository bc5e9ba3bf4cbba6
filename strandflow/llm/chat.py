"""Operator 1: chat logs collapsed to maximal conversations and rendered.

A log often holds a conversation again and again as it grew.  Each turn gets a
rolling hash of the turns up to it (position-bound turn hashes, combined by
exclusive or, 128 bits).  A conversation whose whole hash is the prefix hash of
a longer one is dropped by an anti-join; of equal conversations the one with
the least id stays.  DataFrame functions only.

Prefix hashes of a long conversation are made from blocks of its turns, so that
no single task has to hold it before it is rendered.  Rendering makes one text
of it and so gathers it in one row, as must be: a conversation longer than a
Spark string (2 GB) has no such row.  That goes for turns without a conversation
id as well, which count as one; ``render=False`` gathers nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Values of ``turn`` in one block.
BLOCK = 256
_NONE = -(1 << 63)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` as ``(conv, n, pos, role, text, p1, p2)``: of n turns the place from 1 and the rolling hash up to it."""
    base = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit((1 << 62))).alias("block"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sizes = base.groupBy("conv", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("conv")).alias("n"))
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = base.join(starts, ["conv", "block"]).withColumn("pos", F.col("start") + F.row_number().over(order))
    placed = placed.withColumns({f"h{i}": F.xxhash64(F.lit(i), "pos", "role", "text") for i in (1, 2)})
    sums = placed.groupBy("conv", "block").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    ends = sums.select("conv", "block", *[F.coalesce(F.bit_xor(f"s{i}").over(ahead), F.lit(0)).alias(f"e{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.join(ends, ["conv", "block"])
    return rolled.select("conv", "n", "pos", "role", "text", *[F.bit_xor(f"h{i}").over(upto).bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)])


def maximal_conversations(turns: DataFrame, render: bool = True) -> DataFrame:
    """``(conv_id, n_turns, n_logged, text)``, one row for each conversation that no longer one begins with.

    ``turns`` has ``conv_id, turn, role, text``.  Turns are in the order of
    ``turn`` (nulls last), then role, then text; null roles and texts count as
    empty; repeated turns are turns of their own.  Turns without a conversation
    id form one conversation with a null id.  ``n_logged`` counts the equal
    conversations behind a row.  Without ``render`` there is no ``text``.  An
    empty table gives an empty result; further columns are ignored.
    """
    rolled = stage(prefix_hashes(turns), "chat-prefixes")  # read three times
    whole = rolled.where("pos = n").select("conv", "n", F.col("p1").alias("w1"), F.col("p2").alias("w2"))
    unique = whole.groupBy("n", "w1", "w2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_logged"))
    inner = rolled.where("pos < n").select(F.col("pos").alias("n"), F.col("p1").alias("w1"), F.col("p2").alias("w2")).distinct()
    kept = unique.join(inner, ["n", "w1", "w2"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_logged")
    if not render:
        return kept.select(F.nullif("conv", F.lit(_NONE)).alias("conv_id"), "n_turns", "n_logged")
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    said = rolled.select("conv", "pos", line.alias("line")).join(kept, "conv")
    said = said.groupBy("conv", "n_turns", "n_logged").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return said.select(F.nullif("conv", F.lit(_NONE)).alias("conv_id"), "n_turns", "n_logged", F.array_join("lines.line", "").alias("text"))


#: DuckDB SQL for the query: prefixes compared turn by turn instead of by hashes.
ORACLE = """
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS pos,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations
), whole AS (
  SELECT conv_id, count(*) AS n, list(line ORDER BY pos) AS lines FROM placed GROUP BY conv_id
), uniq AS (
  SELECT n, lines, min(conv_id) AS conv_id, count(*) AS n_logged FROM whole GROUP BY n, lines
), heads AS (
  SELECT DISTINCT lines[1:i] AS lines FROM (SELECT lines, unnest(range(1, n)) AS i FROM uniq)
)
SELECT u.conv_id, u.n AS n_turns, u.n_logged, array_to_string(u.lines, '') AS text
FROM uniq u LEFT JOIN heads h ON u.lines = h.lines WHERE h.lines IS NULL
"""
