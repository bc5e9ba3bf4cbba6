"""Operator 10: uniform sharding by a hypergeometric communication matrix.

Rows of source partition ``i`` go to shard ``j`` in a number ``a[i, j]`` drawn
exactly from the law that a uniform permutation of all rows would give: row
sums are the partition sizes, column sums the wanted shard sizes.  Each
partition is permuted locally, its first ``a[i, 0]`` rows go to shard 0 and so
on, and each shard is permuted again on arrival.

DataFrame and SQL functions only.  The matrix comes from a binary tree over the
partitions: each node splits its vector of free places between its halves by a
multivariate hypergeometric draw, so log2(partitions) steps draw all rows side
by side.  A draw walks out from the mode by the exact ratio of neighbouring
probabilities; terms beyond 10 standard deviations plus 40 places (less of the
mass than a double can hold) are not summed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, shuffle_partitions, stage

#: Bytes of a small table that a join may broadcast.
BROADCAST_BYTES = 16 << 20
#: Rows, and bytes, of a shard that one task sorts.
ROWS_PER_TASK, BYTES_PER_TASK = 1 << 15, 64 << 20
#: Levels of the tree of draws in one plan; then its nodes are written.
LEVELS = 4
#: Types whose values take eight bytes or less.
_PLAIN = frozenset("boolean tinyint smallint int bigint float double date timestamp timestamp_ntz".split())


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, computed once (a lambda would compute it at each step)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(marked: str, total: str, drawn: str, u: str) -> str:
    """SQL: how many of ``drawn`` items, out of ``total``, are among the ``marked``, at quantile ``u``.

    Arguments are SQL for longs and a double in (0, 1).  Values are taken in the
    order mode, mode + 1, ..., mode - 1, ...: any fixed order gives the exact
    law from a uniform ``u``.
    """
    ratio = "((s.k - {x}) * (s.n - {x}) / (({x} + 1d) * (s.big - s.k - s.n + {x} + 1d)))"  # p(x + 1) / p(x)
    after, before = f"(acc.w * {ratio.format(x='x')})", f"(acc.w / {ratio.format(x='x')})"
    walk = "named_struct('w', {w}, 'sum', acc.sum + {w})"
    seek = "named_struct('w', {w}, 'sum', acc.sum + {w}, 'value', if(acc.value is null and acc.sum + {w} >= goal, {v}, acc.value))"
    one = "named_struct('w', 1d, 'sum', 1d)"
    mass = f"aggregate(m.up, {one}, (acc, x) -> {walk.format(w=after)}).sum + aggregate(m.down, {one}, (acc, x) -> {walk.format(w=before)}).sum - 1d"
    rise = f"aggregate(m.up, named_struct('w', 1d, 'sum', 1d, 'value', if(goal <= 1d, m.mode, null)), (acc, x) -> {seek.format(w=after, v='x + 1')})"
    found = f"aggregate(m.down, {_let('r', rise, "named_struct('w', 1d, 'sum', r.sum, 'value', r.value)")}, (acc, x) -> {seek.format(w=before, v='x')}).value"
    ways = (
        "named_struct('mode', mode,"
        " 'up', if(least(s.high, mode + s.reach) > mode, sequence(mode, least(s.high, mode + s.reach) - 1), cast(array() as array<bigint>)),"
        " 'down', if(greatest(s.low, mode - s.reach) < mode, sequence(mode - 1, greatest(s.low, mode - s.reach), -1L), cast(array() as array<bigint>)))"
    )
    drawing = _let("mode", "least(greatest(s.peak, s.low), s.high)", _let("m", ways, f"coalesce({_let('goal', f's.u * ({mass})', found)}, m.mode)"))
    spread = "coalesce(sqrt(a.n * (a.k / greatest(a.big, 1d)) * ((a.big - a.k) / greatest(a.big, 1d)) * ((a.big - a.n) / greatest(a.big - 1d, 1d))), 0d)"
    setting = (
        "named_struct('low', greatest(0L, cast(a.n + a.k - a.big as bigint)), 'high', cast(least(a.n, a.k) as bigint),"
        f" 'peak', cast(floor((a.n + 1d) * (a.k + 1d) / (a.big + 2d)) as bigint), 'reach', cast(ceil({spread} * 10d) as bigint) + 40L, 'u', a.u, 'big', a.big, 'n', a.n, 'k', a.k)"
    )
    given = f"named_struct('k', cast({marked} as double), 'big', cast({total} as double), 'n', cast({drawn} as double), 'u', {u})"
    return _let("a", given, _let("s", setting, f"if(s.low = s.high, s.low, {drawing})"))


def _split(free: str, drawn: str, seed: str) -> str:
    """SQL: of ``drawn`` places, how many come from each entry of ``free``; one exact multivariate draw."""
    u = f"(shiftrightunsigned(xxhash64({seed}, place.j), 11) + 0.5d) / {float(1 << 53)}d"
    got = hypergeometric("place.free", "st.rest", "st.n", u)
    step = _let("g", got, "named_struct('n', st.n - g, 'rest', st.rest - place.free, 'out', concat(st.out, array(g)))")
    start = f"named_struct('n', {drawn}, 'rest', aggregate({free}, 0L, (x, y) -> x + y), 'out', cast(array() as array<bigint>))"
    return f"aggregate(transform({free}, (x, j) -> named_struct('free', x, 'j', j)), {start}, (st, place) -> {step}).out"


def communication_matrix(counts: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """``(block, row)``: for each source block, how many of its rows go to each shard.

    ``counts`` has ``(block, n)``; shard sizes differ by one at most.  The first
    row holds one number for each source partition, never a number for each row.
    Nodes are written every :data:`LEVELS` levels, so no plan grows with the
    number of blocks; empty blocks get rows of zeros.
    """
    spark = counts.sparkSession
    top = counts.agg(F.array_sort(F.collect_list(F.struct(F.col("block").cast("long").alias("block"), F.col("n").cast("long").alias("n")))).alias("blocks"))
    top = top.withColumn("total", F.expr("aggregate(blocks, 0L, (a, x) -> a + x.n)"))
    nodes = top.selectExpr("1L as node", "blocks", f"transform(sequence(0, {shards - 1}), j -> total div {shards} + if(j < total % {shards}, 1L, 0L)) as free")
    levels, written = max(0, math.ceil(math.log2(max(1, counts.count())))), None
    for level in range(levels):
        nodes = nodes.selectExpr("node", "free", "slice(blocks, 1, cast(ceil(size(blocks) / 2) as int)) as left", "filter(blocks, (x, i) -> i >= ceil(size(blocks) / 2)) as right")
        got = _split("free", "aggregate(left, 0L, (a, x) -> a + x.n)", f"{seed}, node")
        nodes = nodes.selectExpr("*", f"if(size(right) > 0, {got}, free) as got")
        one, two = "named_struct('node', node * 2, 'blocks', left, 'free', got)", "named_struct('node', node * 2 + 1, 'blocks', right, 'free', zip_with(free, got, (x, y) -> x - y))"
        nodes = nodes.selectExpr(f"inline(array({one}, {two}))").where("size(blocks) > 0")
        if level % LEVELS == LEVELS - 1 and level < levels - 1:
            nodes = stage(nodes.repartition(min(1 << level + 1, shuffle_partitions(spark)), "node"), "shard-nodes")
            if written is not None:
                drop_staged(written)
            written = nodes
    return nodes.where("size(blocks) > 0").selectExpr("blocks[0].block as block", "free as row")


def _row_bytes(df: DataFrame) -> Column:
    """Rough bytes of a row: its texts and binaries by length, other columns by the length of their text."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) if f.dataType.simpleString() in _PLAIN else F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)).cast("long") for f in df.schema.fields]
    return reduce(lambda a, b: a + b, sizes, F.lit(16).cast("long"))


def shuffle_into_shards(df: DataFrame, shards: int = 24, seed: int = 42, rows_per_task: int = ROWS_PER_TASK, bytes_per_task: int = BYTES_PER_TASK, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in each shard).

    A uniform random permutation of all rows, cut into shards whose row counts
    differ by one at most.  The permuted source partitions are written to the
    shared folder first, so retries of lost tasks see the same rows and draws.
    A shard is sorted in bins of about ``rows_per_task`` rows or
    ``bytes_per_task`` bytes, whichever are more.

    Every row is kept, whatever its nulls and repeats.  Columns of ``df`` that
    are named ``shard_col`` or ``slot_col`` are replaced (give other names to
    keep them); no other name clashes.  Fewer rows than shards leave shards
    empty; an empty table gives an empty one.
    """
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    local = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(None).alias("none")).alias("row"), _row_bytes(df).alias("bytes"), F.rand(seed).alias("key"), F.rand(seed + 1).alias("again")).sortWithinPartitions("key")
    local = stage(local.drop("key").withColumn("pos", F.monotonically_increasing_id()), "shard-source")
    block = F.shiftright("pos", 33)
    counts = stage(local.select(block.alias("block"), "bytes").groupBy("block").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "shard-counts")
    blocks, rows, size = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    matrix = stage(communication_matrix(counts, shards, seed), "shard-matrix")
    drop_staged(counts)
    ends = matrix.selectExpr("block", f"transform(sequence(1, {shards}), j -> aggregate(slice(row, 1, j), 0L, (a, x) -> a + x)) as ends")
    bins = max(1, -(-rows // (shards * rows_per_task)), -(-size // (shards * bytes_per_task)))
    dealt = local.withColumn("block", block).join(F.broadcast(ends) if blocks * shards * 8 <= BROADCAST_BYTES else ends, "block")
    place = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= place)).cast("int")).withColumn("bin", F.floor(F.col("again") * bins).cast("int")).drop("ends", "block", "bytes")
    sizes = dealt.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # a task for each bin, whatever the session's number of partitions
    sorted_ = dealt.repartitionById(int(shards * bins), (F.col("shard") * int(bins) + F.col("bin")).cast("int")).sortWithinPartitions("again", "pos")
    placed = sorted_.withColumn("n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    placed = placed.join(F.broadcast(offsets) if bins * shards * 16 <= BROADCAST_BYTES else offsets, ["shard", "bin"])
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("shard").alias(shard_col), (F.col("offset") + F.col("n") - 1).cast("long").alias(slot_col))
