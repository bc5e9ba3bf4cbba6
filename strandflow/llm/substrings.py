"""Operator 6: exact substring deduplication by seed and extend.

Seeds are winnowed anchors: of every ``window - k + 1`` consecutive k-word hashes
the least is an anchor, so a window of ``window`` words has exactly one anchor,
fixed by the window's own words, and equal windows have equal anchors in equal
places.  Documents are joined on anchors that occur more than once.

From an anchor the match is extended both ways over the run of windows that it
stands for.  Occurrences whose whole runs agree are matched at once, by one
hash for each run; only where a match ends within a run are its windows
compared one by one.  What is left is a union of intervals: the maximal repeats
of at least ``window`` words.  Groups are counted by partial aggregation and
joined back, so a passage in a third of all documents is never gathered in one
task and no pairs are made.

Windows are compared by anchor hash, offset and window hash (128 bits and
place), runs likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, drop_staged, released, stage

WINDOW = 35
#: Words hashed together for an anchor; windows have WINDOW - K + 1 such hashes.
K = 16
#: Windows handled at once within a long text.
BLOCK = 1 << 18


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` of the words' hashes, by doubling."""
    h, have = words, 1
    while have < n:
        step = min(have, n - have)
        h = _mix(h[: len(h) - step], h[step:], salt + have)
        have += step
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the place of its anchor (the first least k-word hash); and the k-word hashes."""
    grams = ngram_hashes(hashes, k)
    return np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1) + np.arange(len(hashes) - window + 1), grams


def _runs(hashes: np.ndarray, window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Block by block: anchor hash, place, first and last window of each anchor's run."""
    for at in range(0, len(hashes) - window + 1, BLOCK):
        part = hashes[at : at + BLOCK + window - 1]
        place, grams = anchors(part, window, k)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        yield grams[place[first]], place[first] + at, first + at, last + at, part, at


def _seed_rows(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = []
            for text in batch.column(2):
                words = text.as_py().split()
                found = [r[0] for r in _runs(word_hashes(words), window, k)] if len(words) >= window else []
                seeds.append(np.concatenate(found) if found else np.empty(0, np.uint64))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in seeds]))).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *seeds]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "key", "seeds"])

    return run


RUN_SCHEMA = "id long, key long, anchor long, first int, length int, back int, whole long, windows array<long>"


def _run_rows(window: int, k: int):
    """Rows with ``wanted`` (their repeated anchors) to one row for each run of those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                want = np.sort(batch.column(3)[row].values.to_numpy(zero_copy_only=False).view(np.uint64))
                for anchor, place, first, last, part, at in _runs(word_hashes(batch.column(2)[row].as_py().split()), window, k):
                    keep = np.isin(anchor, want)
                    if not keep.any():
                        continue
                    anchor, place, first, last = anchor[keep], place[keep], first[keep], last[keep]
                    h = ngram_hashes(part, window, 1000)
                    size = last - first + 1
                    ends = np.cumsum(size)
                    flat = h[np.repeat(first - at, size) + np.arange(ends[-1]) - np.repeat(ends - size, size)]
                    # a run's hash: its windows' hashes, each multiplied by its odd number within the run
                    nth = (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
                    whole = np.add.reduceat(flat * nth * np.uint64(0x9E3779B97F4A7C15), ends - size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(size), batch.column(0)[row].as_py(), np.int64)),
                            pa.array(np.full(len(size), batch.column(1)[row].as_py(), np.int64)),
                            pa.array(anchor.view(np.int64)),
                            pa.array(first.astype(np.int32)),
                            pa.array(size.astype(np.int32)),
                            pa.array((place - first).astype(np.int32)),
                            pa.array(whole.view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat.view(np.int64))),
                        ],
                        ["id", "key", "anchor", "first", "length", "back", "whole", "windows"],
                    )

    return run


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            words = text.as_py().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if marks.is_valid:
                ranges = np.array([(m["first"], m["last"]) for m in marks.as_py()], np.int64)
                np.add.at(gone, ranges[:, 0], 1)
                np.add.at(gone, ranges[:, 1] + 1, -1)
            left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(words if len(left) == len(words) else [words[i] for i in left.tolist()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that agree in ``id`` and ``key`` have the same id and text, and so the same repeats."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(-(1 << 62))).alias("id"), F.xxhash64(text).alias("key"), F.encode(text, "UTF-8").alias("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """``(id, key, first, last)``: inclusive ranges of words that repeated windows cover."""
    keyed = _keyed(docs, id_col, text_col).select("id", "key", "text")
    seeds = stage(keyed.mapInArrow(released(_seed_rows(window, k)), "id long, key long, seeds array<long>"), "repeat-seeds", ARROW_ROWS)
    each = seeds.select("id", "key", F.explode("seeds").alias("anchor"))
    # counts are written before they are joined, so that both sides of a join are plain exchanges and hot keys are split
    twice = stage(each.groupBy("anchor").count().where("count > 1").select("anchor"), "repeat-anchors")
    wanted = each.join(twice, "anchor").groupBy("id", "key").agg(F.collect_set("anchor").alias("wanted"))
    runs = stage(keyed.join(wanted, ["id", "key"]).mapInArrow(released(_run_rows(window, k)), RUN_SCHEMA), "repeat-runs", ARROW_ROWS)
    for done in (seeds, twice):  # the runs are written, nothing reads these again
        drop_staged(done)

    same = ["anchor", "back", "length", "whole"]
    classes = runs.groupBy(*same).agg(F.count("*").alias("n"), F.first(F.struct("id", "key", "first", "windows")).alias("one"))
    classes = stage(classes.select(*same, "n", "one.*"), "repeat-classes")
    shared = runs.join(classes.where("n > 1").select(*same), same).select("id", "key", "first", (F.col("first") + F.col("length") + (window - 2)).alias("last"))

    lone = classes.where("n = 1")
    near = classes.join(stage(lone.select("anchor").distinct(), "repeat-open"), "anchor", "left_semi")
    place = [F.posexplode("windows").alias("nth", "hash")]
    offset = (F.col("back") - F.col("nth")).alias("offset")
    counted = near.select("anchor", "back", "n", *place).select("anchor", offset, "hash", "n").groupBy("anchor", "offset", "hash").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "offset", "hash")
    counted = stage(counted, "repeat-windows")
    single = lone.select("anchor", "back", "id", "key", "first", *place).select("anchor", offset, "hash", "id", "key", (F.col("first") + F.col("nth")).alias("first"))
    single = single.join(counted, ["anchor", "offset", "hash"]).select("id", "key", "first", (F.col("first") + (window - 1)).alias("last"))
    return shared.unionByName(single)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each row's text without the words of repeated windows.

    Words are runs of anything but ASCII white space.  A word goes if some
    ``window`` consecutive words around it start elsewhere too, in this row or
    another; kept words are joined by one space.  Null texts count as empty and
    keep nothing; texts shorter than a window stay whole; repeated rows repeat
    each other; null ids stay null; an empty table gives an empty result;
    further columns are ignored.  No text is cut and no group is capped.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    marks = repeats(docs, id_col, text_col, window, k).groupBy("id", "key").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    rows = _keyed(docs, id_col, text_col).join(marks, ["id", "key"], "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(released(_kept_rows), "doc_id long, n_words long, n_removed long, kept string")


#: DuckDB SQL for the query: all windows are compared as texts, without anchors.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN rep ON rep.h = win.h, (SELECT unnest(range(0, 35)) AS o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
left_ AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS kept, count(gone.p) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_ ON left_.doc_id = d.doc_id
"""
