"""Operator 9: text quality from positive and unlabelled documents.

A linear scorer over a text's signs and shape is fitted by the non-negative
unbiased risk for positive-unlabelled learning with the sigmoid loss:
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))``.  The class prior ``pi`` is estimated
from the same texts: a positives-against-unlabelled classifier gives the density
ratio ``p(x | positive) / p(x)``, which is ``1 / pi`` wherever no negative looks
like ``x``, so on held-back positives its mean estimates ``1 / pi``.

Trusted positives are a bounded sample of the labelled rows.  Unlabelled texts
are all texts outside the held-out third: they are dealt by a hash to groups of
about :data:`ROWS_PER_FIT`, each group is fitted beside the same positives, and
the scorer is the mean of the fits, weighted by rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, drop_staged, released, stage

#: Documented bound of the labelled rows the scorer is fitted on.
POSITIVES = 4000
#: Unlabelled rows that one task fits, about; more rows make more tasks.
ROWS_PER_FIT = 16_384
#: Bytes of a text counted at once.
BLOCK = 1 << 20
_SHAPES = 18
#: ASCII signs, blank included: their shares of a text tell more than letters', which follow the language.
_SIGNS = np.array([b for b in range(0x20, 0x7F) if not chr(b).isalnum()])
FEATURES = len(_SIGNS) + _SHAPES


def features(data: bytes) -> np.ndarray:
    """Profile of signs and shape of one UTF-8 text; all of it is read."""
    out = np.zeros(FEATURES)
    n = len(data)
    if not n:
        out[-1] = 1.0
        return out
    counts, arr = np.zeros(256), np.frombuffer(data, np.uint8)
    for at in range(0, n, BLOCK):
        counts += np.bincount(arr[at : at + BLOCK], minlength=256)
    words = data.split()
    lines = data.split(b"\n")
    m = max(1, len(words))
    lower = data.lower().split()
    out[: len(_SIGNS)] = np.sqrt(counts[_SIGNS] / n)
    upper, digit, alpha = counts[65:91].sum(), counts[48:58].sum(), counts[65:91].sum() + counts[97:123].sum()
    sign = n - alpha - digit - counts[128:].sum() - counts[9:14].sum() - counts[32]
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    bare = sum(not w.isalnum() and w.isascii() and not any(c > 64 for c in w) for w in words)
    longest = max(map(len, words), default=0)
    out[-_SHAPES:] = [
        np.log1p(m) / 10,
        sign / n,
        np.log1p(100 * sign / n),
        upper / max(1, alpha),
        np.log1p(20 * upper / max(1, alpha)),
        repeated / m,
        np.log1p(50 * repeated / m),
        len(set(lower)) / m,
        np.log1p(m / max(1, len(set(lower)))),
        len(set(lines)) / len(lines),
        digit / n,
        n / m / 20,
        sum(w.isupper() for w in words) / m,
        bare / m,
        np.log1p(50 * bare / m),
        counts[128:].sum() / n,
        np.log1p(longest) / 10,
        0.0,
    ]
    return out


@dataclass(frozen=True)
class Scorer:
    weight: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        # features are added one after the other, so that equal texts have equal scores wherever they stand
        z = (np.clip((x - self.mean) / self.scale, -8, 8) * self.weight).T.copy().sum(axis=0) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _blank(prior: float | None = None) -> Scorer:
    return Scorer(np.zeros(FEATURES), 0.0, np.zeros(FEATURES), np.ones(FEATURES), prior or 0.5)


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 300, decay: float = 1e-3) -> float:
    """Share of positives among ``u``, from standardised features with a column of ones.

    ``decay`` grows as the samples shrink.
    """
    decay += 5 / max(1, min(len(p), len(u)))
    fit, check = p[::2], p[1::2]
    if not len(fit) or not len(check) or not len(u):
        return 0.5

    def gradient(w: np.ndarray) -> np.ndarray:  # both sides weigh the same
        return -0.5 * (1 - _sigmoid(fit @ w)) @ fit / len(fit) + 0.5 * _sigmoid(u @ w) @ u / len(u) + decay * w

    w = _adam(gradient, p.shape[1], steps, 0.02)
    g = _sigmoid(check @ w)
    return float(np.clip(1.0 / max(1.0, np.mean(g / (1 - g))), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600, decay: float = 1e-4, moments: tuple[np.ndarray, np.ndarray] | None = None) -> Scorer:
    """Minimise the non-negative unbiased risk over a linear scorer.

    Where the negative part of the risk falls below zero, its gradient is turned
    round, as the non-negative estimator prescribes.  Without positives or
    unlabelled texts every score is 0.5.  ``moments`` are the features' means
    and deviations where they are known already.
    """
    if not len(positive) or not len(unlabelled):
        return _blank(prior)
    both = np.concatenate([positive, unlabelled])
    mean, scale = moments or (both.mean(0), both.std(0))
    scale = scale + 0.02
    ready = lambda x: np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
    p, u = ready(positive), ready(unlabelled)
    pi = prior if prior is not None else estimate_prior(p, u)
    decay += 0.3 / min(len(p), len(u))

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        # sigmoid loss of a positive label is 1 - s, of a negative one s
        slope_p, slope_u = (sp * (1 - sp)) @ p / len(p), (su * (1 - su)) @ u / len(u)
        negative = su.mean() - pi * sp.mean()
        step = slope_u - pi * slope_p
        return (-pi * slope_p + step if negative >= 0 else -step) + decay * w

    start = _adam(lambda w: -(1 - _sigmoid(p @ w)) @ p / len(p) * pi + _sigmoid(u @ w) @ u / len(u) * (1 - pi) + decay * w, p.shape[1], 100, 0.02)
    seen = [start.copy()]

    def from_start(w: np.ndarray) -> np.ndarray:
        return gradient(w + seen[0])

    w = seen[0] + _adam(from_start, p.shape[1], steps, 0.01)
    return Scorer(w[:-1], float(w[-1]), mean, scale, pi)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _text(text_col: str):
    return F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")


def _vector(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.float32)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each task: number, sums and sums of squares of the vectors."""
    n, s, q = 0, np.zeros(FEATURES), np.zeros(FEATURES)
    for batch in batches:
        if batch.num_rows:
            x = np.stack([_vector(v.as_py()) for v in batch.column(0)]).astype(np.float64)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate([s, q])], pa.list_(pa.float64()))], ["n", "sums"])


def _added(rows: DataFrame, column: str, size: int, weight: str = "1") -> tuple[int, np.ndarray]:
    """Sum of ``n``, and of the arrays of a column element by element, with weights."""
    row = rows.agg(F.sum("n"), F.array(*[F.sum(F.col(column)[i] * F.expr(weight)) for i in range(size)])).first()
    return int(row[0] or 0), np.array([v or 0.0 for v in row[1]])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVES, rows_per_fit: int = ROWS_PER_FIT) -> Scorer:
    """Fit on up to ``positives`` texts labelled 1 and on all texts outside the held-out third.

    The positives are the ids with the least hashes, so they are the same on
    every run and every layout; only their features come to the driver, and of
    the rest the fitted weights, added up.  Repeated ids count once among the
    positives and as often as they occur among the unlabelled; rows without an
    id are unlabelled ones.  Without positives or other texts every score is 0.5.
    """
    spark = docs.sparkSession
    rank = F.xxhash64(F.col("id"), F.lit("quality"))
    free = labels.where(~held_out(id_col)).where(F.col(id_col).isNotNull() & (F.col(label_col) == 1))
    good = [int(r["id"]) for r in free.select(F.col(id_col).cast("long").alias("id")).distinct().orderBy(rank, "id").limit(positives).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).astype(np.float32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "x"])

    rows = docs.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), _text(text_col)).mapInArrow(released(run), "id long, x binary")
    rows = stage(rows, "quality-features", ARROW_ROWS)
    wanted = spark.createDataFrame(pd.DataFrame({"id": np.array(good, np.int64)}), "id long")  # at most ``positives`` ids
    trusted = sorted((r["id"], bytes(r["x"])) for r in rows.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("x").alias("x")).collect())
    p = np.array([_vector(x) for _, x in trusted], np.float64).reshape(-1, FEATURES)
    n, sums = _added(rows.select("x").mapInArrow(_moments, "n long, sums array<double>"), "sums", 2 * FEATURES)
    if not n or not len(p):
        drop_staged(rows)
        return _blank()
    mean = (sums[:FEATURES] + p.sum(0)) / (n + len(p))
    scale = np.sqrt(np.maximum((sums[FEATURES:] + (p * p).sum(0)) / (n + len(p)) - mean**2, 0))
    groups = -(-n // rows_per_fit)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = [v.as_py() for batch in batches for v in batch.column(0)]
        if n := len(x):
            x = np.frombuffer(b"".join(x), np.float32).reshape(n, FEATURES).astype(np.float64)
            got = fit(p, x, moments=(mean, scale))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.concatenate([got.weight, [got.bias, got.prior]])], pa.list_(pa.float64()))], ["n", "w"])

    dealt = rows.select("x", F.xxhash64("id", "x").alias("place")).repartitionById(groups, F.pmod("place", F.lit(groups)).cast("int")).sortWithinPartitions("place", "x")
    fitted = stage(dealt.select("x").mapInArrow(released(fits), "n long, w array<double>"), "quality-fits")
    _, w = _added(fitted, "w", FEATURES + 2, "n")
    w /= n
    drop_staged(rows)
    drop_staged(fitted)
    return Scorer(w[:FEATURES], float(w[FEATURES]), mean, scale + 0.02, float(w[FEATURES + 1]))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, then the columns in ``keep``.

    The score reads the text alone.  Null texts count as empty and get a score
    too; repeated rows and null ids keep their rows; very long texts are read
    whole, a block at a time; an empty table gives an empty result; columns that
    are not in ``keep`` are ignored, whatever their names.
    """

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer.score(np.array([features(bytes(t)) for t in texts]).reshape(-1, FEATURES)))

    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), scored(_text(text_col)).alias("score"), kept.alias("kept"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"kept.`{c}`").alias(c) for c in keep])
