"""Operator 8: quartile bucket digests of documents.

Byte triplets within a sliding window are hashed to buckets and counted.  A
digest holds, for each bucket, which quartile of the counts it falls in (two
bits), the text's length on a logarithmic scale and two ratios of the
quartiles.  Two digests differ by a score bounded by :func:`most`; their
likeness is one less that score's share of its bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

BUCKETS = 128
#: Offsets of a triplet's later bytes from its first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4))
#: Digest layout: length, ratios, then four buckets to a byte.
HEADER = 3
#: Bytes of a text counted at once.
BLOCK = 1 << 20
#: Score of quartile codes 0 to 3 steps apart; the header parts count up to so much each.
STEPS = np.array([0, 1, 2, 6])
LENGTH_BOUND, RATIO_BOUND = 24, 12

_CODE_PAIR = np.array([[sum(int(STEPS[abs((a >> s & 3) - (b >> s & 3))]) for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.int64)


def most() -> int:
    return BUCKETS * int(STEPS[-1]) + LENGTH_BOUND + 2 * RATIO_BOUND


def triplet_counts(data: bytes) -> np.ndarray:
    """How many triplets of the bytes fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    reach = max(o for t in TRIPLETS for o in t)
    for at in range(0, len(data), BLOCK):
        part = np.frombuffer(data, np.uint8)[at : at + BLOCK + reach].astype(np.uint32)
        firsts = min(BLOCK, len(part))
        for salt, (i, j) in enumerate(TRIPLETS):
            n = min(firsts, len(part) - j)
            if n > 0:
                h = part[:n] * np.uint32(0x9E3779B1) + part[i : i + n] * np.uint32(0x85EBCA6B) + part[j : j + n] * np.uint32(0xC2B2AE35) + np.uint32(salt * 0x27D4EB2F)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> bytes:
    """The digest of a text's bytes; that of an empty text is all zero."""
    counts = triplet_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    length = min(255, round(8 * np.log2(len(data) + 1)))
    ratios = [int(15 * q / q3) if q3 else 0 for q in (q1, q2)]
    return bytes([length, *ratios]) + packed.astype(np.uint8).tobytes()


def difference(a: bytes, b: bytes) -> int:
    """Bounded difference score of two digests; 0 for equal ones."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    head = np.abs(x[:HEADER].astype(int) - y[:HEADER].astype(int))
    return int(_CODE_PAIR[x[HEADER:], y[HEADER:]].sum() + min(head[0], LENGTH_BOUND) + np.minimum(head[1:], RATIO_BOUND).sum())


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / most()


def with_digest(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the hexadecimal digest of each text (null: empty) in ``out_col``."""

    @F.pandas_udf("string")
    def hexed(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: digest(bytes(t)).hex())

    return docs.withColumn(out_col, hexed(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")))


def _place(splits: list[int]) -> Column:
    """How many of the ascending splits are below ``_id``."""
    if not splits:
        return F.lit(0).cast("long")
    halving = F.expr(f"aggregate(sequence(1, {len(splits).bit_length() + 1}), named_struct('a', 0L, 'b', {len(splits)}L), (s, _i) -> if(s.a >= s.b, s, if(_splits[(s.a + s.b) div 2] < _id, named_struct('a', (s.a + s.b) div 2 + 1L, 'b', s.b), named_struct('a', s.a, 'b', (s.a + s.b) div 2))))")
    return halving["a"]


def _ranges(quantiles: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Distinct splits, how many ranges the ids of each alone fill, and the number of the first of its ranges.

    Ranges are numbered in the order of rows: from the largest id down.  An id
    that is several quantiles fills as many ranges, by the hash of its texts;
    the ids between it and the next split share the range after them.
    """
    splits = sorted(set(quantiles))
    fills = [n if (n := quantiles.count(s)) > 1 else 0 for s in splits]
    first, number = [0] * len(splits), 1  # range 0: above all splits
    for i in range(len(splits) - 1, -1, -1):
        first[i], number = number, number + fills[i] + 1
    return splits, fills, first


def _bucket(quantiles: list[int]) -> Column:
    """The number of a row's range, from ``_id``, ``_hash`` and ``_splits``."""
    splits, fills, first = _ranges(quantiles)
    if not splits:
        return F.lit(0)
    at = _place(splits)
    number = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), at.cast("int") + 1)
    heavy = (F.col("_id") == F.col("_splits")[at.cast("int")]) & (number(fills) > 0)
    # the hash of a text as a share of all hashes, from the least up
    share = F.col("_hash").cast("double") / float(1 << 64) + 0.5
    part = F.least(F.floor(share * number(fills)), number(fills) - 1)
    return F.when(at == len(splits), 0).otherwise(number(first) + F.when(heavy, part).otherwise(number(fills))).cast("int")


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``following`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``(bucket, extra, doc_id, text)`` to a row for each that is no extra."""
    held = None
    ready = False

    def close(row, text: str | None, print_: bytes | None) -> tuple:
        doc_id, own, own_print = row
        new = edited(own, text if text is not None else own)
        new_print = digest(new.encode())
        return (doc_id, len(own), sha256(new.encode()).hexdigest(), own_print.hex(), new_print.hex(), likeness(own_print, new_print), likeness(own_print, print_ if print_ is not None else own_print))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        out = []
        for bucket, extra, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            bucket, extra, text = bucket.as_py(), extra.as_py(), text.as_py()
            if held is not None and held[0] != bucket:
                out.append(close(held[1], None, None))  # nothing follows: only where one row is all there is
                held = None
            if held is None and extra:
                continue
            print_ = digest(text.encode())
            if held is not None:
                out.append(close(held[1], text, print_))
            held = None if extra else (bucket, (doc_id.as_py(), text, print_))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(close(held[1], None, None), kinds, strict=True)], names)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each row's digest, its edited text's and the next row's, and their likeness.

    The next row is that of the next lower id; after the last comes the first.
    Rows are dealt into ranges of ids (quantiles of all ids), a task for each
    range, and sorted there; the first row of each range is copied to the end of
    the range before it, so texts are shuffled once and no range needs another.
    An id that fills several quantiles (nulls are one) is dealt by its texts.

    Null texts count as empty.  Null ids come last; rows of one id are in the
    order of their texts, and where ids fill several ranges in that of the
    texts' hashes (``xxhash64``), then texts, so that only rows that agree in
    both must share a task.  A lone row follows itself.  An empty table gives an
    empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    last = -(1 << 63)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("_id"))
    n = buckets or shuffle_partitions(spark)
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else None
    quantiles = ids.agg(F.percentile_approx("_id", shares, max(10_000, 20 * n))).first()[0] or [] if shares is not None else []
    splits = F.array(*[F.lit(s).cast("long") for s in sorted(set(quantiles))]).cast("array<long>")
    with_range = lambda df: df.withColumn("_splits", splits).withColumn("_own", _bucket(quantiles)).drop("_splits")
    # the first row of each range: texts are hashed only where an id fills several
    several = [s for s in set(quantiles) if quantiles.count(s) > 1]
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("_id"), text.alias("text"))
    hashed = F.xxhash64("text") if several else F.lit(0).cast("long")
    marked = with_range(keyed.withColumn("_hash", hashed).drop("text"))
    first = F.max(F.struct("_id", (F.lit(-1) - F.col("_hash")).alias("_turned"))).alias("top")
    heads = {r["_own"]: (r["top"]["_id"], -1 - r["top"]["_turned"]) for r in marked.groupBy("_own").agg(first).collect()}  # a row for each range
    order = sorted(heads)
    facts = [(b, i, *heads[b], (i - 1) % len(order)) for i, b in enumerate(order)]  # the first range's head also ends the last
    heads_table = spark.createDataFrame(facts, "_own int, bucket int, _head long, _head_hash long, copy_to int")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = with_range(rows.withColumn("_id", F.coalesce("doc_id", F.lit(last))).withColumn("_hash", hashed)).join(F.broadcast(heads_table), "_own")
    own, copy = F.struct("bucket", F.lit(0).alias("extra")), F.struct(F.col("copy_to").alias("bucket"), F.lit(1).alias("extra"))
    both = F.when((F.col("_id") == F.col("_head")) & (F.col("_hash") == F.col("_head_hash")), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.select("_id", "_hash", "doc_id", "text", F.explode(both).alias("to")).select("to.bucket", "to.extra", "_id", "_hash", "doc_id", "text")
    dealt = dealt.repartitionById(max(1, len(order)), F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc("_id"), "_hash", "text").select("bucket", "extra", "doc_id", "text")
    return dealt.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
