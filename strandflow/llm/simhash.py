"""Operator 7: SimHash near-duplicates found with BK-trees.

A document's fingerprint sums the bits of its word-shingle hashes.  Distinct
fingerprints are routed to shards by blocks of their bits: of ``radius + 1``
blocks two fingerprints within the radius share at least one, so every link
lies inside some shard.  Each shard builds BK-trees (children keyed by integer
Hamming distance to the parent) of bounded size and follows only edges within
the radius.  A shard emits a spanning forest of its links, never all pairs, and
a star-contraction over those edges gives the components.

Trees travel with the shuffle of their shard rather than through the driver:
broadcasting every shard's tree would collect all fingerprints there (a node
takes 268 bytes and lies in three shards: 0.1 GB for 0.5 GB of documents, and
ever more with them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stage
from .components import connected

RADIUS = 2
#: Nodes of one BK-tree at most, on average; larger shards are dealt again by their free bits.
TREE_NODES = 4096
#: Rows that a fingerprint may become by that.
SPREAD = 81
#: Edges of a tree tried at once.
EDGES = 1 << 18
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text; 0 where it has no words."""
    words = text.lower().split()  # ASCII only, on bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    tails = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest, ones, at = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    while at < last:
        to = min(last, at + BLOCK)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), tails[at:to].tolist())], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at = to
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``: the id and the signed 64-bit fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle, seed) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """BK-tree over distinct 64-bit values, built and searched level by level."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.child = np.full((max(1, len(values)), 65), -1, np.int32)
        rest = np.arange(1, len(values))
        parent = np.zeros(len(rest), np.int64)
        while len(rest):
            edge = np.bitwise_count(values[rest] ^ values[parent]).astype(np.int64)
            _, first, inverse = np.unique(parent * 65 + edge, return_index=True, return_inverse=True)
            self.child[parent[first], edge[first]] = rest[first]
            heads = rest[first][inverse]
            keep = heads != rest
            rest, parent = rest[keep], heads[keep]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, node) at a distance of ``radius`` or less."""
        if not len(self.values):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        step = max(1, EDGES // (2 * radius + 1))  # a dense tree sends many pairs down at once; their edges are tried in slices
        reach = np.arange(-radius, radius + 1, dtype=np.int16)
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found_q, found_node = [], []
        while len(q):
            next_q, next_node = [], []
            for at in range(0, len(q), step):
                qs, nodes = q[at : at + step], node[at : at + step]
                distance = np.bitwise_count(queries[qs] ^ self.values[nodes]).astype(np.int16)
                hit = distance <= radius
                found_q.append(qs[hit])
                found_node.append(nodes[hit])
                edges = distance[:, None] + reach
                to = np.where((edges >= 1) & (edges <= 64), self.child[nodes[:, None], np.clip(edges, 0, 64)], -1)
                row, col = np.nonzero(to >= 0)
                next_q.append(qs[row])
                next_node.append(to[row, col].astype(np.int64))
            q, node = np.concatenate(next_q), np.concatenate(next_node)
        return np.concatenate(found_q), np.concatenate(found_node)


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``a[i]`` and ``b[i]`` in ``label``, in place; labels are least members."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def _forest(radius: int):
    """Rows ``(key, part, block, fp, mine)`` sorted by shard (nodes before queries) to forest edges ``(a, b)``.

    A shard of ``part`` equal to ``block`` has nodes alone and is searched
    against itself; in any other the queries of ``block`` ask the tree of ``part``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nodes, tree, label = None, [], None, None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def grow() -> None:
            nonlocal tree, label
            tree = BKTree(np.concatenate(nodes) if nodes else np.empty(0, np.uint64))
            label = np.arange(len(tree.values))
            if shard[1] == shard[2]:
                for at in range(0, len(label), 512):
                    q, n = tree.search(tree.values[at : at + 512], radius)
                    union(label, q + at, n)

        def ask(queries: np.ndarray):
            for at in range(0, len(queries), 512):
                part = queries[at : at + 512]
                q, n = tree.search(part, radius)
                _, first = np.unique(q, return_index=True)
                link = np.full(len(part), -1)
                link[q[first]] = n[first]
                union(label, link[q], n)  # all the nodes that one query touches
                yield out(part[q[first]], tree.values[n[first]])

        def close():
            if tree is None and nodes:
                grow()
            if tree is not None:
                moved = np.flatnonzero(label != np.arange(len(label)))
                yield out(tree.values[moved], tree.values[label[moved]])

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            is_node = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(fp)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shard != (here := tuple(key[:, a].tolist())):
                    yield from close()
                    shard, nodes, tree, label = here, [], None, None
                mine = is_node[a:b]
                if mine.any():
                    nodes.append(fp[a:b][mine])
                if not mine.all():
                    if tree is None:
                        grow()
                    yield from ask(fp[a:b][~mine])
        yield from close()

    return run


def block_pairs(rows: DataFrame, members: str, own: str, blocks: str) -> DataFrame:
    """Rows of shards cut into ``blocks`` to the pairs of blocks they meet in: ``(part, block, mine)`` beside ``members``.

    A row of block ``own`` is a node of every pair whose first block is its own
    and a query of those whose second is: so a pair has two blocks at most, and
    no shard is ever one task.
    """
    at = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)).alias("other")
    met = rows.select(*members.split(), own, at)
    least, most = F.least("other", own), F.greatest("other", own)
    return met.select(*members.split(), least.cast("long").alias("part"), most.cast("long").alias("block"), (F.col(own) == least).cast("int").alias("mine"))


def _cuts(free: int, n: int) -> list[int]:
    """Masks that deal the free bits to ``n`` blocks of nearly equal width, lowest bits first."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << b for b in bits[i * len(bits) // n : (i + 1) * len(bits) // n]) for i in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(prints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``(key, part, block, fp, mine)``: the distinct values of ``prints.fp`` in every shard that may link them.

    Members of a shard share the bits of its block.  A shard of more than
    ``tree_nodes`` members is dealt again by blocks of the bits that are still
    free, which is exact for the same reason, and so on while that multiplies
    rows by no more than :data:`SPREAD`.  What is larger even then is cut into
    parts that meet in pairs.
    """
    n = radius + 1
    levels = max(1, int(math.log(SPREAD, n) + 1e-9)) if n > 1 else 1
    free, dealt, ready = [(1 << 64) - 1], prints.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key")), []
    for level in range(levels):
        masks = [m for f in free for m in _cuts(f, n)]
        free = [f & ~m for f in free for m in _cuts(f, n)]
        wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((F.col("path") * n + i).cast("int").alias("path"), F.xxhash64("key", F.col("path") * n + i, F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), (F.col("path") * n + i + 1).cast("int")).bitwiseAND(F.col("fp"))).alias("key")))
        dealt = dealt.select("fp", F.explode(wanted).alias("to")).select("fp", "to.path", "to.key")
        # written first, so that both sides of the join are plain exchanges and a hot key is split
        sizes = stage(dealt.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / tree_nodes).cast("int").alias("blocks")), "simhash-shards")
        placed = dealt.join(sizes, "key")
        hot = level + 1 < levels and bool(sizes.where("blocks > 1").limit(1).count())
        ready.append(placed.where("blocks = 1") if hot else placed)
        if not hot:
            break
        dealt = stage(placed.where("blocks > 1").select("fp", "path", "key"), "simhash-hot")
    rows = reduce(DataFrame.unionByName, ready).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    return block_pairs(rows, "key fp", "own", "blocks").select("key", "part", "block", "fp", "mine")


def forest_edges(prints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Edges ``(a, b)`` that span the links among the distinct values of ``prints.fp``."""
    spread = shards(prints, radius, tree_nodes).repartition(shuffle_partitions(prints.sparkSession), "key", "part", "block").sortWithinPartitions("key", "part", "block", F.desc("mine"))
    return spread.mapInArrow(_forest(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3, seed: int = 42, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    Null texts count as empty; empty texts have fingerprint 0 and link like any
    other.  Rows that share an id keep a row each.  A null id never becomes a
    ``component_id`` unless its component has no other id.  An empty table gives
    an empty result; further columns of ``docs`` are ignored.
    """
    prints = stage(with_fingerprint(docs, id_col, text_col, shingle, seed), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(forest_edges(distinct.select("fp"), radius, tree_nodes))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "simhash-roots")
    ids = stage(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    labels = named.join(ids, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


__all__ = ["BKTree", "block_pairs", "fingerprint", "forest_edges", "near_duplicates", "union", "with_fingerprint"]
