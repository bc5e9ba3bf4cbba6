"""Near copies of documents: SimHash and BK-trees over five-word shingles, then exact similarity.

Documents alike to 0.8 in their shingle sets differ in about ten of 64 SimHash
bits, far more than bit blocks can route.  So shards come from bands of least
shingle hashes: documents of similarity 0.8 share one of six bands of two with
probability 0.998 (more for closer ones).  Within a shard a BK-tree finds the
fingerprints within :data:`RADIUS` bits, and each such pair that is not yet in
one class is verified by the Jaccard similarity of the shingle sets.  A shard
emits a spanning forest, never all pairs.  A shard of more than
:data:`TREE_NODES` documents is cut into blocks that meet in pairs, so no task
holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, released, shuffle_partitions, stage
from .components import connected
from .simhash import BLOCK, BKTree, block_pairs, union
from .substrings import ngram_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 6, 2
#: Bits that fingerprints of similar documents may differ in: 3.6 deviations above the mean of 9.7 at 0.8 for large sets.
#: Of sets of four and five shingles (12 bits expected) 0.5% differ in more and are lost.
RADIUS = 20
TREE_NODES = 2048


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (all its words, if fewer; none, if it has none)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(word_hashes(words), min(shingle, len(words)), 77))


def sketch(hashes: np.ndarray) -> tuple[int, int, list[int]]:
    """Of a shingle set: its own hash, its SimHash and its bands."""
    if not len(hashes):
        return 0, 0, [0] * BANDS
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])
    least = np.array([(h ^ (h >> np.uint64(31))).min() for i in range(BANDS * ROWS) for h in [(hashes ^ np.uint64(0x5851F42D4C957F2D * (i + 1) & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)]], np.uint64).reshape(BANDS, ROWS)
    bands = ngram_hashes(least.T[0], 1) * np.uint64(0xBF58476D1CE4E5B9) + least.T[1] + np.arange(BANDS, dtype=np.uint64)
    own = int((hashes * np.uint64(0xD6E8FEB86659FD93) ^ (hashes >> np.uint64(32))).sum(dtype=np.uint64)) ^ len(hashes)
    return own, fp, bands.tolist()


def _sketch_rows(shingle: int):
    def signed(xs: list[int]) -> pa.Array:
        return pa.array(np.array(xs, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(2)]
            rows = [sketch(s) for s in sets]
            flat = [b for r in rows for b in r[2]]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), signed(flat))
            # 32 bits of each hash: of sets of n shingles a share of about n / 2**32 is taken for equal by chance
            packed = pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed([r[0] for r in rows]), signed([r[1] for r in rows]), bands, packed], ["id", "key", "node", "fp", "bands", "shingles"])

    return run


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verified_forest(radius: int, similarity: float):
    """Sorted shard rows ``(band, part, block, node, fp, mine, shingles)`` to edges ``(a, b)`` of similar documents.

    As in :mod:`.simhash`, a shard of one block is searched against itself and
    any other is a tree of ``part`` asked by ``block``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree, label, nodes = None, [], None, None, []

        def grow() -> None:
            nonlocal tree, nodes, label
            first: dict[int, list[int]] = {}
            for i, (_, fp, _) in enumerate(held):
                first.setdefault(fp, []).append(i)
            nodes = list(first.values())  # documents of one fingerprint share a node
            tree = BKTree(np.array(list(first), np.uint64))
            label = np.arange(len(held))

        def similar(a: tuple, b: tuple) -> bool:
            return min(len(a[2]), len(b[2])) >= similarity * max(len(a[2]), len(b[2])) and _jaccard(a[2], b[2]) >= similarity

        def within() -> Iterator[tuple[int, int]]:
            for at in range(0, len(tree.values), 64):
                q, n = tree.search(tree.values[at : at + 64], radius)
                for x, y in zip((q + at).tolist(), n.tolist()):
                    if x < y:
                        continue
                    for i in nodes[x]:
                        for j in nodes[y]:
                            if label[i] != label[j] and similar(held[i], held[j]):
                                union(label, np.array([i]), np.array([j]))
                                yield held[i][0], held[j][0]

        def across(row: tuple) -> Iterator[tuple[int, int]]:
            _, n = tree.search(np.array([row[1]], np.uint64), radius)
            first, seen = None, set()
            for j in (j for y in n.tolist() for j in nodes[y]):
                if int(label[j]) not in seen and similar(row, held[j]):
                    if first is None:
                        first = j
                    else:
                        union(label, np.array([first]), np.array([j]))  # one document joins their classes
                    seen = {int(label[first]), *seen}
                    yield row[0], held[j][0]

        def ready() -> list[tuple[int, int]]:
            if not held or tree is not None:
                return []
            grow()
            return list(within()) if shard[1] == shard[2] else []

        def packed(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for band, part, block, node, fp, mine, shingles in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if shard != (band, part, block):
                    out += ready()
                    shard, held, tree = (band, part, block), [], None
                row = (node, fp & (1 << 64) - 1, np.frombuffer(shingles, np.uint32))
                if mine:
                    held.append(row)
                else:
                    out += ready()
                    out += across(row) if tree is not None else []
            yield packed(out)
        yield packed(ready())

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``(id, key, group, kept)``: each row's group of near copies, named by its least id, and whether it is the one kept.

    ``key`` is ``xxhash64`` of the text.  Null texts count as empty, and all
    texts without words are copies of each other.  Of a group the row with the
    least id (then key) is kept; rows that agree in id and text are kept or
    dropped together; null ids come last.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.encode(text, "UTF-8").alias("text"))
    rows = stage(rows.mapInArrow(released(_sketch_rows(shingle)), "id long, key long, node long, fp long, bands array<long>, shingles binary"), "copies-sketches", ARROW_ROWS)
    each = rows.select("node", "fp", F.explode("bands").alias("band")).distinct()
    sizes = each.groupBy("band").count().where("count > 1").select("band", F.ceil(F.col("count") / tree_nodes).cast("int").alias("blocks"))
    asked = each.join(stage(sizes, "copies-shards"), "band").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    sets = rows.select("node", "shingles").groupBy("node").agg(F.first("shingles").alias("shingles"))
    asked = block_pairs(asked.join(sets, "node"), "band node fp shingles", "own", "blocks").select("band", "part", "block", "node", "fp", "mine", "shingles")
    spread = asked.repartition(shuffle_partitions(docs.sparkSession), "band", "part", "block").sortWithinPartitions("band", "part", "block", F.desc("mine"))
    roots = connected(spread.mapInArrow(released(_verified_forest(radius, similarity)), "a long, b long"))
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("key").alias("key"))
    named = rows.select("id", "key", "node").join(roots, "node", "left").select("id", "key", F.coalesce("root", "node").alias("root"))
    named = stage(named, "copies-groups")
    heads = stage(named.groupBy("root").agg(F.min(place).alias("head")), "copies-heads")
    out = named.join(heads, "root")
    return out.select("id", "key", F.col("head.id").alias("group"), (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies; columns and kept rows as they were."""
    gone = near_copies(docs, id_col, text_col, **options).where("not kept").select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone_id"]) & (key == gone["_gone_key"]), "left_anti")
