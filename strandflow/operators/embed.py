"""Scoring of embeddings: silhouette, margin logits, pooling, summary values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from .numbering import unit_interval


#: Bytes of class vectors that are broadcast in one row; beyond that classes are joined by dimension.
BROADCAST_BYTES = 64 << 20


def _fit_a_row(classes: DataFrame, vectors: str) -> bool:
    n = classes.agg(F.coalesce(F.sum(F.size(vectors).cast("long")), F.lit(0))).first()[0]
    return n * 8 <= BROADCAST_BYTES


def _class_dots(rows: DataFrame, classes: DataFrame, v: str, k: str) -> DataFrame:
    """``rows`` (keyed by ``_r``) with ``_dots``: structs of each class's columns and ``dot``, whatever the number of classes."""
    others = [c for c in classes.columns if c != k]
    x = rows.select("_r", F.posexplode(v).alias("_d", "_a"))
    y = classes.select(F.struct(*others).alias("_c"), F.posexplode(k).alias("_d", "_b"))
    dots = x.join(y, "_d").groupBy("_r", "_c").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))
    return rows.join(dots.groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("_c", "dot"))).alias("_dots")), "_r")


def silhouette(df: DataFrame, embedding: str = "embedding", label: str = "label", *, sample: float | None = None, seed: int = 42) -> DataFrame:
    """One row with the mean cosine silhouette, exact without pairs; null with fewer than two labels.

    The mean distance of a vector to a class is one less its dot product with
    the mean of the class's unit vectors.  Vectors of a class alone score 0.
    ``sample`` keeps a share of the rows by a hash of their vector.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("c"), S.l2_norm(embedding).alias("v"))
    if sample is not None:
        rows = rows.where(unit_interval(F.lit(seed), F.col("v")) < sample)
    sums = rows.select("c", F.posexplode("v").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    means = sums.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda z: z["s"]).alias("s"), F.max("n").alias("n"))
    gap = lambda c, n, dot: F.when(c == F.col("c"), (n - dot) / F.greatest(n - 1, F.lit(1))).otherwise(1 - dot / n)
    if _fit_a_row(means, "s"):
        table = means.agg(F.collect_list(F.struct("c", "s", "n")).alias("classes"))  # one entry for each class
        scored = rows.crossJoin(F.broadcast(table))
        gaps = F.transform("classes", lambda k: F.struct(k["c"].alias("c"), k["n"].alias("n"), gap(k["c"], k["n"], S.dot(F.col("v"), k["s"])).alias("gap")))
    else:
        keyed = rows.withColumn("_r", F.xxhash64("v", "c")).dropDuplicates(["_r"])
        counts = rows.groupBy(F.xxhash64("v", "c").alias("_r")).agg(F.count("*").alias("_times"))
        scored = _class_dots(keyed, means, "v", "s").join(counts, "_r").withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
        gaps = F.transform("_dots", lambda k: F.struct(k["_c"]["c"].alias("c"), k["_c"]["n"].alias("n"), gap(k["_c"]["c"], k["_c"]["n"], k["dot"]).alias("gap")))
    scored = scored.select("c", gaps.alias("g"))
    own = F.filter("g", lambda k: k["c"] == F.col("c"))[0]
    other = F.array_min(F.transform(F.filter("g", lambda k: k["c"] != F.col("c")), lambda k: k["gap"]))
    score = scored.select(F.size("g").alias("classes"), own["n"].alias("n"), own["gap"].alias("a"), other.alias("b"))
    value = F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return score.agg(F.when(F.max("classes") >= 2, F.avg(value)).alias("silhouette"))


def curricular_logits(df: DataFrame, centroids: DataFrame, *, embedding: str = "embedding", label: str | None = None, margin: float = 0.5, scale: float = 64.0, tau: float = 0.0) -> DataFrame:
    """``df`` with ``logits`` over the centroids ``(class, centroid)``, in the order of ``class``.

    Without ``label`` these are scaled cosines.  With one they are training
    logits: the target's angle grows by the margin and harder classes weigh
    ``tau`` more.  ``target_cosine`` is what the running ``tau`` is updated by.
    """
    clip = lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    unit = centroids.select("class", S.l2_norm("centroid").alias("centroid"))
    rows = df.withColumn("_x", S.l2_norm(embedding))
    if _fit_a_row(centroids, "centroid"):
        table = unit.agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "centroid"))), lambda z: z["centroid"]).alias("_k"))
        rows = rows.crossJoin(F.broadcast(table))  # one row holds the classes
        cos = F.transform("_k", lambda k: clip(S.dot(F.col("_x"), k)))
    else:
        rows = _class_dots(rows.withColumn("_r", F.monotonically_increasing_id()), unit, "_x", "centroid").drop("_r").withColumnRenamed("_dots", "_k")
        cos = F.transform("_k", lambda k: clip(k["dot"]))
    rows = rows.withColumn("_cos", cos)
    if label is None:
        return rows.withColumn("logits", F.transform("_cos", lambda c: c * scale)).drop("_k", "_x", "_cos")
    t = F.col("_cos")[F.col(label).cast("int")]
    hard = t * math.cos(margin) - F.sqrt(F.greatest(1 - t * t, F.lit(0.0))) * math.sin(margin)
    target = F.when(t > math.cos(math.pi - margin), hard).otherwise(t - math.sin(math.pi - margin) * margin)
    logits = F.transform("_cos", lambda c, i: F.when(i == F.col(label), target).when(c > hard, c * (tau + c)).otherwise(c) * scale)
    return rows.withColumn("logits", logits).withColumn("target_cosine", t).drop("_k", "_x", "_cos")


def updated_tau(rows: DataFrame, tau: float = 0.0, alpha: float = 0.01) -> float:
    """The running mean of target cosines after one batch."""
    mean = rows.agg(F.avg("target_cosine")).first()[0]
    return tau if mean is None else tau + alpha * (mean - tau)


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    x = F.col(logits)
    top = F.array_max(x)
    return df.agg(F.avg(F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top - x[F.col(label).cast("int")]).alias("loss"))


def value_stats(df: DataFrame, values: str) -> DataFrame:
    """Mean, standard deviation and sum over all values of array rows."""
    x = df.select(F.explode(values).alias("x")).select(F.col("x").cast("double").alias("x"))
    return x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev("x").alias("std"), F.sum("x").alias("total"))


def pca(df: DataFrame, embedding: str = "embedding", components: int = 2) -> DataFrame:
    """Linear projection (not a neighbour embedding) by Spark's own principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>")))
    return PCA(k=components, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("projection", vector_to_array("_p")).drop("_v", "_p")


def reduce_embeddings(df: DataFrame, reducer_factory=None, embedding: str = "embedding", *, key: str = "vec_id", seed: int = 42, neighbors: int | None = None, min_dist: float = 0.001, metric: str = "cosine", components: int = 2, max_rows: int = 100_000, **options):
    """Fit a neighbour-embedding plug-in on the driver and return ``(reducer, projected)``.

    ``reducer_factory`` makes an object with ``fit_transform``.  It is fitted on
    ``max_rows`` rows at most, those with the least hashes of their keys;
    :func:`project_embeddings` places all others.  Neighbours default to
    ``max(5, int(log(n)))``.  Without a factory this raises: no such library is
    part of this package.
    """
    if reducer_factory is None:
        raise ValueError("Give a reducer_factory; see pca() for a built-in linear projection")
    import numpy as np

    sample = df.select(key, embedding).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(max_rows)
    local = sample.orderBy(key).toPandas()
    if local.empty:
        raise ValueError("There are no embeddings")
    x = np.array(local[embedding].tolist(), float)
    reducer = reducer_factory(n_neighbors=neighbors or max(5, int(math.log(max(len(x), 2)))), min_dist=min_dist, metric=metric, n_components=components, random_state=seed, **options)
    return reducer, np.asarray(reducer.fit_transform(x))


def project_embeddings(df: DataFrame, reducer, embedding: str = "embedding") -> DataFrame:
    """``df`` with the ``projection`` of each vector by a fitted reducer's ``transform``, in Arrow batches; the reducer goes to the executors with the task."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def placed(vectors):  # noqa: ANN001, ANN202
        import pandas as pd

        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.asarray(reducer.transform(np.array(vectors.tolist(), float)), float)))

    return df.withColumn("projection", placed(F.col(embedding).cast("array<double>")))


def mean_vectors(df: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """``(label, d, x)``: each class's mean vector, an element a row; no class is gathered in one row."""
    return df.select(label, F.posexplode(embedding).alias("d", "x")).groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
