"""One-vs-rest ROC curves and areas from distinct scores and running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.operators.scale import prefix_sums


def score_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per (key, class, distinct score); equal scores merge early."""
    return (
        preds.select(*by, "y_true", F.posexplode("probs").alias("class_index", "score"))
        .groupBy(*by, "class_index", "score")
        .agg(
            F.count_if(F.col("y_true") == F.col("class_index")).alias("pos"),
            F.count_if(F.col("y_true") != F.col("class_index")).alias("neg"),
        )
    )


def roc_auc_per_class(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area per class: share of (positive, negative) pairs ranked right, ties half.

    NULL when the class has no positives or no negatives.
    """
    by = list(by)
    counted = prefix_sums(
        score_counts(preds, by), [*by, "class_index"], ["score"], {"neg_upto": "neg"}
    )
    # neg_upto includes the tied negatives, so the lower ones plus half the ties is
    # neg_upto - neg / 2.
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    sums = counted.groupBy(*by, "class_index").agg(
        F.sum(won).alias("won"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return sums.select(
        *by,
        "class_index",
        "positives",
        "negatives",
        (F.col("won") / F.nullif(pairs, F.lit(0.0))).alias("auc"),
    )


def roc_auc_ovr(preds: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted area; NULL when any of the ``k`` classes is undefined."""
    areas = roc_auc_per_class(preds, by)
    defined = F.count("auc") == k
    return areas.groupBy(*by).agg(
        F.when(defined, F.avg("auc")).alias("roc_auc_ovr_macro"),
        F.when(
            defined, F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")
        ).alias("roc_auc_ovr_weighted"),
    )


def roc_curve(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All curve points by descending threshold: tp, fp, tpr, fpr (origin not included)."""
    by = list(by)
    points = prefix_sums(
        score_counts(preds, by),
        [*by, "class_index"],
        [F.col("score").desc()],
        {"tp": "pos", "fp": "neg"},
        {"_p": "pos", "_n": "neg"},
    )
    return points.select(
        *by,
        "class_index",
        F.col("score").alias("threshold"),
        "tp",
        "fp",
        (F.col("tp") / F.nullif("_p", F.lit(0))).alias("tpr"),
        (F.col("fp") / F.nullif("_n", F.lit(0))).alias("fpr"),
    )
