"""Masked-language-model collation; draws are fixed by seed, row and place, so results do not depend on partitioning."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from .numbering import uniform, uniform_values

IGNORED = -100
#: Neighbours that :func:`dilate` looks at one by one; of more it makes a slice at each place.
NEAR = 16


def check_neighborhood(left: int, right: int) -> None:
    for x in (left, right):
        if not isinstance(x, int) or isinstance(x, bool) or x < 0:
            raise AssertionError("Mask neighbourhoods must be integers that are not negative")


def dilate(hits: Column, left: int, right: int) -> Column:
    """Hits (booleans by place) spread to their neighbourhood; ends of the row are reached only by their own hits."""

    def spread(made: Column) -> Column:  # hits made once, not again at each place
        n = F.size(made)

        def covered(hit: Column, i: Column) -> Column:
            inner = (i >= 1) & (i < n - 1)
            if left + right <= NEAR:
                near = [F.when((i + d >= 0) & (i + d < n), made[i + d]).otherwise(False) for d in range(-right, left + 1) if d]
                return hit | (inner & reduce(or_, near)) if near else hit
            around = F.slice(made, F.greatest(i - right, F.lit(0)) + 1, F.least(i + left, n - 1) - F.greatest(i - right, F.lit(0)) + 1)
            return hit | (inner & F.exists(around, lambda x: x))

        return F.transform(made, covered)

    return S.let(hits, spread)


def dilated(hits: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray, left: int, right: int) -> np.ndarray:
    """:func:`dilate` of rows that lie end to end: ``row`` of each place, ``first`` and ``end`` of each row."""
    at = np.flatnonzero(hits)
    low, high = np.maximum(at - left, first[row[at]] + 1), np.minimum(at + right, end[row[at]] - 2)
    some = low <= high
    steps = np.zeros(len(hits) + 1, np.int32)
    np.add.at(steps, low[some], 1)
    np.add.at(steps, high[some] + 1, -1)
    return hits | (np.cumsum(steps[:-1]) > 0)


def mask_tokens(
    rows: DataFrame,
    vocabulary_size: int,
    *,
    row_id: str = "row_id",
    ids: str = "input_ids",
    probability: float = 0.05,
    left: int = 3,
    right: int = 2,
    replace: float = 0.8,
    random: float = 0.01,
    seed: int = 42,
) -> DataFrame:
    """``rows`` with masked ``input_ids`` and ``labels`` (−100 off the mask).

    Seeds fall on tokens that are no specials; a mask spreads ``left`` and
    ``right`` of each.  Masked tokens become MASK with chance ``replace``, of the
    rest a random id with chance ``random``, else stay.

    A numpy kernel over Arrow batches: neighbourhoods by running sums over the
    few hits, where array lambdas would look around every place; fates are drawn
    for masked places alone.
    """
    check_neighborhood(left, right)

    @F.arrow_udf("array<array<int>>")
    def masked(row_ids: pa.Array, lists: pa.Array) -> pa.Array:
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
        end = np.cumsum(sizes)
        first = end - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(values)) - first[row]
        key = np.array(row_ids.fill_null(0), np.int64)[row]
        hits = (values >= len(S.SPECIALS)) & (uniform_values(seed, 1, key, place) < probability)
        at = np.flatnonzero(dilated(hits, row, first, end, left, right))
        fate = lambda salt: uniform_values(seed, salt, key[at], place[at])
        labels = np.full(len(values), IGNORED, np.int64)
        labels[at] = values[at]
        other = np.where(fate(3) < random, (fate(4) * vocabulary_size).astype(np.int64), values[at])
        values[at] = np.where(fate(2) < replace, S.MASK, other)
        # a row's ids, then its labels
        both = np.empty(2 * len(values), np.int32)
        both[np.arange(len(values)) + first[row]] = values
        both[np.arange(len(values)) + end[row]] = labels
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.repeat(sizes, 2)))).astype(np.int32)), pa.array(both))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(sizes) + 1, 2, dtype=np.int32)), inner)

    out = rows.withColumn("_both", masked(F.col(row_id).cast("long"), F.col(ids)))
    null = F.col(ids).isNull()
    return out.withColumns({"labels": F.when(~null, F.col("_both")[1]), ids: F.when(~null, F.col("_both")[0])}).drop("_both")


def mask_positions(ids: Column, positions: Column, left: int = 3, right: int = 3) -> Column:
    """Struct of ``input_ids`` masked around given token places and ``labels`` of the original ids."""

    def masked(row: Column) -> Column:  # ids and places made once, not again at each token
        hit = lambda i: F.exists(row["places"], lambda p: (i >= p - left) & (i <= p + right))
        return F.struct(
            F.transform(row["ids"], lambda x, i: F.when(hit(i), F.lit(S.MASK)).otherwise(x)).alias("input_ids"),
            F.transform(row["ids"], lambda x, i: F.when(hit(i), x).otherwise(F.lit(IGNORED))).alias("labels"),
        )

    return S.let(F.struct(ids.alias("ids"), positions.alias("places")), masked)


def mask_bases(df: DataFrame, k: int, shift: int, *, sequence: str = "sample_seq", bases: str = "pos2mask", left: int = 3, right: int = 3, max_length: int = 200) -> DataFrame:
    """``df`` with ids masked around the tokens over given bases."""
    ids = S.truncate_ids(S.encode_ids(sequence, k, shift), max_length)
    places = F.transform(F.col(bases), lambda p: S.token_position(p, F.length(sequence), k, shift))
    out = df.withColumn("_m", mask_positions(ids, places, left, right))
    return out.select(*df.columns, "_m.input_ids", "_m.labels", S.attention_mask("_m.input_ids").alias("attention_mask"))


DISTRIBUTIONS = ("uniform", "normal", "exponential")


def random_windows(
    rows: DataFrame,
    max_length: int,
    *,
    row_id: str = "row_id",
    ids: str = "input_ids",
    min_length: int = 0,
    distribution: str = "uniform",
    mean: float | None = None,
    scale: float | None = None,
    truncation: float = 0.8,
    special: bool = True,
    seed: int = 42,
    pad: bool = True,
) -> DataFrame:
    """Random sub-windows of token rows, with ends added and rows padded to the longest.

    With chance ``truncation`` a row starts at a uniform place and ends at one
    drawn from the distribution (an absolute place, so a window can be empty);
    else it starts at 0 and is only cut to ``max_length``.  Labels are the first
    of ``labels``, ``label`` and ``y`` that there is.
    """
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"The distribution must be one of {DISTRIBUTIONS}")
    u = lambda salt: uniform(seed, salt, F.col(row_id))
    n, top = F.size(ids), max_length - 2 * special
    short = F.when(n < min_length, F.raise_error(F.lit("A row is shorter than the least length")).cast("int")).otherwise(n)
    cut = F.lit(truncation) >= u(1)
    middle, spread = mean if mean is not None else (min_length + max_length) / 2, scale if scale is not None else max(1.0, (max_length - min_length) / 6)
    if distribution == "uniform":
        drawn = min_length + u(2) * (max_length - min_length)
    elif distribution == "normal":
        drawn = middle + spread * F.sqrt(-2 * F.log(1 - u(2))) * F.cos(2 * F.pi() * u(3))
    else:
        drawn = -F.log(1 - u(2)) * spread
    end = F.when(cut, F.least(F.greatest(drawn.cast("int"), F.lit(min_length)), F.lit(top), short)).otherwise(F.least(short, F.lit(top)))
    start = F.when(cut, F.floor(u(4) * (F.greatest(n - max_length, F.lit(0)) + 1)).cast("int")).otherwise(F.lit(0))
    out = rows.withColumn("_s", start).withColumn("_e", end)
    body = F.when(F.col("_e") > F.col("_s"), F.slice(F.col(ids), F.col("_s") + 1, F.col("_e") - F.col("_s"))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn(ids, S.with_specials(body) if special else body)
    given = [c for c in ("labels", "label", "y") if c in rows.columns]
    if given:
        out = out.withColumn("labels", F.coalesce(*[F.col(c) for c in given]))
    if pad:
        width = int(out.agg(F.coalesce(F.max(F.size(ids)), F.lit(0))).first()[0])
        out = out.withColumn(ids, S.pad_ids(ids, width))
    return out.withColumn("attention_mask", S.attention_mask(ids, (S.PAD,))).withColumnRenamed("_s", "window_start").withColumnRenamed("_e", "window_end")


def window_label_distributions(rows: DataFrame, labels: str = "labels_dist", ids: str = "input_ids", classes: int = 4) -> DataFrame:
    """Per-place label distributions cut to each row's window and padded with zeros; without any, labels are the ids."""
    if labels not in rows.columns:
        return rows.withColumn("labels", F.col(ids))
    cut = F.when(F.col("window_end") > F.col("window_start"), F.slice(F.col(labels), F.col("window_start") + 1, F.col("window_end") - F.col("window_start"))).otherwise(F.array().cast("array<array<double>>"))
    zero = F.array(*[F.lit(0.0)] * classes)
    return rows.withColumn("labels", F.concat(cut, F.array_repeat(zero, F.greatest(F.size(ids) - F.size(cut), F.lit(0)))))
