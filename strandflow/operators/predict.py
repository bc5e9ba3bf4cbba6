"""Sequence-level predictions and classification metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from .checks import check_expected_columns


def _probability_columns(df: DataFrame) -> tuple[str, str]:
    for a, b in (("p_class_0", "p_class_1"), ("p_class0", "p_class1")):
        if a in df.columns and b in df.columns:
            return a, b
    raise ValueError("The following columns are missing: ['p_class_0', 'p_class_1']")


def weighted_voting(df: DataFrame) -> DataFrame:
    """Mean class probabilities of each sequence, the larger class (ties: 0) and the true one if there is ``y``.

    Rows without a sequence id are left out; a sequence with several labels
    gives a row for each.
    """
    check_expected_columns(df, ["sequence_id"])
    p0, p1 = _probability_columns(df)
    rows = df.where(F.col("sequence_id").isNotNull())
    mean = rows.groupBy("sequence_id").agg(F.avg(p0).alias("p_class_0"), F.avg(p1).alias("p_class_1"))
    mean = mean.withColumn("y_pred", F.when(F.col("p_class_1") > F.col("p_class_0"), 1).otherwise(0))
    if "y" not in df.columns:
        return mean.withColumn("y_true", F.lit(None).cast("int"))
    return mean.join(rows.select("sequence_id", F.col("y").alias("y_true")).distinct(), "sequence_id", "left")


def logits_to_sequence_predictions(df: DataFrame, order: str | None = None) -> DataFrame:
    """Mean logits of each sequence to softmax probabilities, the larger class and the first label by ``order``."""
    label = F.min_by("y", order) if order else F.min("y")
    mean = df.where(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(F.avg("logit_y0").alias("l0"), F.avg("logit_y1").alias("l1"), label.alias("y_true"))
    p = S.softmax(F.array("l0", "l1"))
    return mean.withColumn("_p", p).select("sequence_id", F.col("_p")[0].alias("p_class_0"), F.col("_p")[1].alias("p_class_1"), F.when(F.col("l1") > F.col("l0"), 1).otherwise(0).alias("y_pred"), "y_true")


def prediction_rows(df: DataFrame, logits: str = "logits", label: str = "y") -> DataFrame:
    """``(y, y_pred, logit_y0, logit_y1)`` of each row of logits."""
    x = F.col(logits)
    return df.select(F.col(label).alias("y"), S.argmax(x).alias("y_pred"), x[0].cast("double").alias("logit_y0"), x[1].cast("double").alias("logit_y1"))


def auc(df: DataFrame, score: str, label: str = "y") -> DataFrame:
    """One row with the exact area under the curve, ties counted half; -1 with one class only.

    Rows are first counted by distinct score, so the running sum is over scores.
    """
    from pyspark.sql import Window

    by = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n"))
    # buckets of scores keep the unbounded running sum off a single task
    cuts = by.agg(F.percentile_approx("s", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 10_000).alias("c"))
    placed = by.crossJoin(F.broadcast(cuts)).withColumn("b", F.size(F.filter("c", lambda c: c < F.col("s")))).drop("c")
    starts = placed.groupBy("b").agg(F.sum("n").alias("m")).select("b", F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = placed.join(F.broadcast(starts), "b").select("p", "n", (F.col("p") * (F.col("before") + below + F.col("n") / F.lit(2.0))).alias("won"))
    total = part.agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p").cast("double") * F.col("n"))).otherwise(-1.0).alias("auc"))


def one_vs_rest_auc(df: DataFrame, classes: list[int], scores: str, label: str = "y") -> DataFrame:
    """One row with the mean over classes of each class's exact area against all others; NaN where a class has no rows or all.

    ``scores`` is an array with a score for each class, in their order.
    """
    each = [auc(df.select(F.col(scores)[i].alias("s"), F.when(F.col(label) == c, 1).when(F.col(label).isNotNull(), 0).alias("y")), "s") for i, c in enumerate(classes)]
    parts = reduce(DataFrame.unionByName, each)
    return parts.agg(F.avg(F.when(F.col("auc") >= 0, F.col("auc")).otherwise(float("nan"))).alias("auc"))


def confusion(df: DataFrame, prediction: str = "y_pred", label: str = "y") -> DataFrame:
    hit = lambda y, p: F.sum(((F.col(label) == y) & (F.col(prediction) == p)).cast("long"))
    return df.agg(*[F.coalesce(hit(y, p), F.lit(0)).alias(n) for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def binary_metrics(df: DataFrame, prediction: str = "y_pred", label: str = "y", *, guarded: bool = False) -> DataFrame:
    """One row of confusion counts and ratios; with ``guarded`` an empty denominator gives 0, else null (MCC: 0)."""
    c = confusion(df, prediction, label)
    tn, fp, fn, tp = (F.col(n).cast("double") for n in ("tn", "fp", "fn", "tp"))
    over = (lambda a, b: a / F.greatest(b, F.lit(1.0))) if guarded else (lambda a, b: F.try_divide(a, b))
    recall, specificity = over(tp, tp + fn), over(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        over(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        over(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0).alias("mcc"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        recall.alias("recall"),
        recall.alias("sensitivity"),
        specificity.alias("specificity"),
        over(tp, tp + fp).alias("precision"),
        over(tn, tn + fn).alias("npv"),
        "tn",
        "fp",
        "fn",
        "tp",
        (F.col("tp") + F.col("fn")).alias("np"),
        (F.col("tn") + F.col("fp")).alias("nn"),
    )


def evaluate_binary(rows: DataFrame) -> DataFrame:
    """Metrics of ``(y, y_pred, logit_y0, logit_y1)`` with both areas and the cross entropy of ``sigmoid(logit_y1)``."""
    p = S.sigmoid(F.col("logit_y1"))
    e = 1e-15
    p = F.least(F.greatest(p, F.lit(e)), F.lit(1 - e))
    ce = rows.agg((-F.avg(F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("eval_loss"))
    a0, a1 = auc(rows, "logit_y0").withColumnRenamed("auc", "auc_class0"), auc(rows, "logit_y1").withColumnRenamed("auc", "auc_class1")
    return binary_metrics(rows).crossJoin(ce).crossJoin(a0).crossJoin(a1)  # one row each


def multiclass_metrics(df: DataFrame, prediction: str = "y_pred", label: str = "y") -> DataFrame:
    """Accuracy and recall weighted by class, from a table of (label, prediction) counts."""
    cells = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    by = cells.groupBy("y").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    total = by.agg(F.sum("hit").alias("hit"), F.sum("all").alias("all"), F.sum(F.col("all") * (F.col("hit") / F.col("all"))).alias("w"))
    return total.select((F.col("hit") / F.col("all")).alias("accuracy"), (F.col("w") / F.col("all")).alias("recall"))


def evaluate_sequences(segments: DataFrame, *, compat: bool = True) -> DataFrame:
    """Segment logits ``(sequence_id, y, logit_y0, logit_y1)`` to sequence metrics.

    With ``compat`` the log probabilities stand in for logits, as in the tool
    this follows, so the loss is that of ``p / (1 + p)``.
    """
    votes = weighted_voting(segment_probabilities(segments))
    log = (lambda c: F.log(F.greatest(F.col(c), F.lit(1e-300)))) if compat else (lambda c: F.col(c))
    return evaluate_binary(votes.select(F.col("y_true").alias("y"), "y_pred", log("p_class_0").alias("logit_y0"), log("p_class_1").alias("logit_y1")))


def segment_probabilities(segments: DataFrame) -> DataFrame:
    p = segments.withColumn("_p", S.softmax(F.array("logit_y0", "logit_y1")))
    return p.select("sequence_id", *[c for c in ("y",) if c in segments.columns], F.col("_p")[0].alias("p_class_0"), F.col("_p")[1].alias("p_class_1"))


def predict_sequences(segments: DataFrame) -> DataFrame:
    """Sequence predictions without truth: ``(sequence_id, predicted_label, p_class_0, p_class_1)``."""
    votes = weighted_voting(segment_probabilities(segments.drop("y")))
    return votes.select("sequence_id", class_label(F.col("y_pred")).alias("predicted_label"), "p_class_0", "p_class_1")


def class_label(y):
    return F.when(y == 1, "class_1").otherwise("class_0")


def masked_lm_metrics(df: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 100), logits: str = "logits", label: str = "label") -> DataFrame:
    """Rank, reciprocal rank, hits, loss and perplexity over places whose label is not −100; nulls if there are none.

    The rank counts strictly greater logits, so ties rank together.
    """
    x = F.col(logits).cast("array<double>")
    rows = df.where(F.col(label) != -100).select(x.alias("x"), F.col(label).cast("int").alias("t"))
    true = F.col("x")[F.col("t")]
    top = F.array_max("x")
    rows = rows.select((F.size(F.filter("x", lambda v: v > true)) + 1).alias("rank"), (F.log(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top - true).alias("loss"))
    out = rows.agg(
        F.count("*").alias("n_masked"),
        F.avg("rank").alias("avg_rank"),
        F.percentile("rank", 0.5).cast("int").alias("median_rank"),
        F.avg(1.0 / F.col("rank")).alias("mrr"),
        *[F.avg((F.col("rank") <= k).cast("int")).alias(f"hit_at_{k}") for k in ks],
        F.avg("loss").alias("loss"),
    )
    return out.withColumn("perplexity", F.exp("loss"))


def soft_label_kl(df: DataFrame, predicted: str = "logits", wanted: str = "labels_dist", row: str = "row_id") -> DataFrame:
    """Mean over rows of the divergence of soft labels from predictions, summed over places with labels."""
    p = F.transform(F.col(wanted).cast("array<double>"), lambda x: F.greatest(x, F.lit(1e-8)))
    rows = df.where(F.aggregate(F.col(wanted).cast("array<double>"), F.lit(0.0), lambda a, x: a + x) > 0).select(row, S.let(p, lambda x: S.let(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), lambda s: F.transform(x, lambda y: y / s))).alias("p"), S.softmax(predicted).alias("q"))
    kl = F.aggregate(F.zip_with("p", "q", lambda a, b: a * (F.log(a) - F.log(F.greatest(b, F.lit(1e-300))))), F.lit(0.0), lambda s, x: s + x)
    return rows.agg((F.sum(kl) / F.count_distinct(row)).alias("loss"))
