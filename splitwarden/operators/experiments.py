"""Fold summaries, leaderboards, seed comparison, metric gaps, selection and histories.

Metric tables are tall: keys, ``metric``, ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.operators.metrics import ece_name
from splitwarden.operators.scale import bounded_broadcast, number_rows

# Fixed value: t quantile used for every fold count.
T_CRITICAL = 2.776
# Direction of each metric.
HIGHER_IS_BETTER = (
    "accuracy",
    "balanced_accuracy",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "precision_weighted",
    "recall_weighted",
    "f1_weighted",
    "specificity_macro",
    "specificity_weighted",
    "cohen_kappa",
    "matthews_correlation_coefficient",
    "roc_auc_ovr_macro",
    "roc_auc_ovr_weighted",
)
LOWER_IS_BETTER = (
    "log_loss",
    "brier_score_multiclass",
    ece_name(),
    "confidence_accuracy_gap",
)
# Wording of the two directions.
HIGHER_TEXT = "positive means the first split scored higher"
LOWER_TEXT = "positive means the second split has higher error"


def metric_gaps(
    metrics: DataFrame, pairs: Sequence[tuple[str, str]], role: str, by: Sequence[str] = ()
) -> DataFrame:
    """Gap per metric and pair of roles; positive always means the second role is worse.

    ``role`` names the column that tells the two sides apart. Metrics without a known
    direction and metrics missing on a side are left out.
    """
    known = metrics.filter(
        F.col("metric").isin(*HIGHER_IS_BETTER, *LOWER_IS_BETTER) & F.col("value").isNotNull()
    ).select(*by, role, "metric", "value")
    wanted = F.array(
        *[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs]
    )
    # Each row meets the pairs it belongs to, then one grouping puts the sides together.
    sides = known.withColumn("p", F.explode(wanted)).filter(
        (F.col(role) == F.col("p.first")) | (F.col(role) == F.col("p.second"))
    )
    both = (
        sides.groupBy(*by, "p", "metric")
        .agg(
            F.max(F.when(F.col(role) == F.col("p.first"), F.col("value"))).alias("first_value"),
            F.max(F.when(F.col(role) == F.col("p.second"), F.col("value"))).alias("second_value"),
        )
        .filter("first_value IS NOT NULL AND second_value IS NOT NULL")
    )
    higher = F.col("metric").isin(*HIGHER_IS_BETTER)
    gap = F.col("first_value") - F.col("second_value")
    return both.select(
        *by,
        F.concat_ws("_vs_", "p.first", "p.second").alias("comparison"),
        "metric",
        "first_value",
        "second_value",
        F.when(higher, gap).otherwise(-gap).alias("generalization_gap"),
        F.abs(gap).alias("absolute_difference"),
        F.when(higher, HIGHER_TEXT).otherwise(LOWER_TEXT).alias("interpretation"),
    )


def summarize_metrics(tall: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation, range and 95 % interval per metric over folds.

    Values that are not numbers are dropped; one value has deviation and margin 0.
    """
    value = F.col("value")
    if dict(tall.dtypes)["value"] == "string":
        value = value.try_cast("double")
    numbers = tall.select(*by, "metric", value.alias("value")).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    sums = numbers.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("standard_deviation"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.count("*").alias("fold_count"),
    )
    margin = T_CRITICAL * F.col("standard_deviation") / F.sqrt("fold_count")
    return sums.select(
        *by,
        "metric",
        "mean",
        "standard_deviation",
        "minimum",
        "maximum",
        (F.col("mean") - margin).alias("ci95_lower"),
        (F.col("mean") + margin).alias("ci95_upper"),
        "fold_count",
    )


def per_class_summary(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of the class scores over folds, total support."""
    scores = {
        "precision": "precision",
        "recall": "recall_sensitivity",
        "specificity": "specificity",
        "f1": "f1_score",
    }
    aggregates: list[Column] = []
    for name, column in scores.items():
        aggregates += [
            F.avg(column).alias(f"{name}_mean"),
            F.stddev_samp(column).alias(f"{name}_std"),
        ]
    return per_class.groupBy(*by, "class_index").agg(
        *aggregates, F.sum("support").alias("support_total")
    )


def _mean(metric: str) -> Column:
    return F.avg(F.when(F.col("metric") == metric, F.col("value")))


def _std(metric: str) -> Column:
    return F.stddev_samp(F.when(F.col("metric") == metric, F.col("value")))


def ranked(df: DataFrame, f1: str, accuracy: str, loss: str) -> DataFrame:
    """Leaderboard order: F1 down, accuracy down, log loss up."""
    return df.orderBy(F.col(f1).desc(), F.col(accuracy).desc(), F.col(loss).asc())


def leaderboard(folds: DataFrame, run: str = "experiment") -> DataFrame:
    """One row per run from its fold results, best first."""
    board = folds.groupBy(run).agg(
        _mean("validation_accuracy").alias("validation_accuracy_mean"),
        _std("validation_accuracy").alias("validation_accuracy_std"),
        _mean("validation_f1_macro").alias("validation_f1_macro_mean"),
        _std("validation_f1_macro").alias("validation_f1_macro_std"),
        _mean("validation_log_loss").alias("validation_log_loss_mean"),
        _mean("validation_roc_auc_ovr_macro").alias("validation_roc_auc_macro_mean"),
        _mean("gap_accuracy").alias("accuracy_gap_mean"),
        _mean("gap_f1_macro").alias("f1_gap_mean"),
    )
    return ranked(
        board,
        "validation_f1_macro_mean",
        "validation_accuracy_mean",
        "validation_log_loss_mean",
    )


def seed_results(
    folds: DataFrame,
    per_class: DataFrame,
    confusion: DataFrame,
    class_a: int,
    class_b: int,
) -> DataFrame:
    """Per (experiment, seed): fold means, scores of two classes, confusions between them."""
    keys = ["experiment", "seed"]
    means = folds.groupBy(*keys).agg(
        _mean("validation_accuracy").alias("validation_accuracy_mean"),
        _mean("validation_f1_macro").alias("validation_f1_macro_mean"),
        _mean("validation_log_loss").alias("validation_log_loss_mean"),
        _mean("validation_roc_auc_ovr_macro").alias("validation_roc_auc_macro_mean"),
        _mean("gap_accuracy").alias("accuracy_gap_mean"),
        _mean("gap_f1_macro").alias("f1_gap_mean"),
    )

    def of(label: int, column: str) -> Column:
        return F.max(F.when(F.col("class_index") == label, F.col(column)))

    classes = per_class.groupBy(*keys).agg(
        of(class_a, "recall_sensitivity").alias("class_a_recall"),
        of(class_a, "f1_score").alias("class_a_f1"),
        of(class_b, "f1_score").alias("class_b_f1"),
    )

    def moved(truth: int, predicted: int) -> Column:
        cell = (F.col("y_true") == truth) & (F.col("y_pred") == predicted)
        return F.coalesce(F.sum(F.when(cell, F.col("n"))), F.lit(0))

    errors = confusion.groupBy(*keys).agg(
        moved(class_a, class_b).alias("a_to_b_errors"),
        moved(class_b, class_a).alias("b_to_a_errors"),
    )
    missing = F.raise_error(F.lit("a run lacks metrics of a required class")).cast("double")
    joined = means.join(classes, keys, "left").join(errors, keys, "left")
    return joined.withColumns(
        {
            "class_a_f1": F.coalesce("class_a_f1", missing),
            "class_b_f1": F.coalesce("class_b_f1", missing),
            "total_errors": F.col("a_to_b_errors") + F.col("b_to_a_errors"),
        }
    )


def multiseed(per_seed: DataFrame) -> DataFrame:
    """Per experiment over its seeds, best first."""
    summary = per_seed.groupBy("experiment").agg(
        F.count("seed").alias("seed_count"),
        F.avg("validation_accuracy_mean").alias("accuracy_mean_across_seeds"),
        F.stddev_samp("validation_accuracy_mean").alias("accuracy_std_across_seeds"),
        F.avg("validation_f1_macro_mean").alias("macro_f1_mean_across_seeds"),
        F.stddev_samp("validation_f1_macro_mean").alias("macro_f1_std_across_seeds"),
        F.avg("validation_log_loss_mean").alias("log_loss_mean_across_seeds"),
        F.avg("validation_roc_auc_macro_mean").alias("roc_auc_mean_across_seeds"),
        F.avg("accuracy_gap_mean").alias("accuracy_gap_mean_across_seeds"),
        F.avg("f1_gap_mean").alias("f1_gap_mean_across_seeds"),
        F.avg("class_a_recall").alias("class_a_recall_mean"),
        F.avg("class_a_f1").alias("class_a_f1_mean"),
        F.avg("class_b_f1").alias("class_b_f1_mean"),
        F.avg("total_errors").alias("total_errors_mean"),
    )
    return ranked(
        summary,
        "macro_f1_mean_across_seeds",
        "accuracy_mean_across_seeds",
        "log_loss_mean_across_seeds",
    )


def fold_results(
    metrics: DataFrame, keys: Sequence[str], role: str = "role"
) -> DataFrame:
    """Tall fold table: ``train_*``, ``validation_*`` and ``gap_*`` per key and fold."""
    prefixed = metrics.select(
        *keys, F.concat_ws("_", role, "metric").alias("metric"), "value"
    )
    gaps = metric_gaps(metrics, [("train", "validation")], role, keys).select(
        *keys,
        F.concat(F.lit("gap_"), "metric").alias("metric"),
        F.col("generalization_gap").alias("value"),
    )
    return prefixed.unionByName(gaps)


def select_candidate(metrics: DataFrame, by: Sequence[str], candidate: str) -> DataFrame:
    """Flag the best candidate per key: F1, then accuracy, then low loss, then first."""
    best = metrics.groupBy(*by).agg(
        F.min_by(
            F.col(candidate),
            F.struct(
                -F.col("f1_macro"), -F.col("accuracy"), F.col("log_loss"), F.col(candidate)
            ),
        ).alias("_best")
    )
    return (
        metrics.join(best, list(by))
        .withColumn("selected", F.col(candidate) == F.col("_best"))
        .drop("_best")
    )


def history_table(history: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """Epoch counters per phase and over phases, and the train/validation gaps.

    Needs ``phase_order`` and ``epoch`` (unique within a run's phase).
    """
    numbered = number_rows(
        history,
        [*run, "phase_order", "epoch"],
        {"phase_epoch": [*run, "phase_order"], "global_epoch": list(run)},
    )
    return numbered.withColumns(
        {
            "accuracy_gap_train_minus_validation": F.col("accuracy") - F.col("val_accuracy"),
            "loss_gap_validation_minus_train": F.col("val_loss") - F.col("loss"),
        }
    )


def best_epoch(history: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """Epoch with the least validation loss, the first on ties."""
    return history.groupBy(*run).agg(
        F.min_by("epoch", F.struct("val_loss", "phase_order", "epoch")).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
    )


def overlay_configs(
    base: DataFrame, overrides: DataFrame, names: Sequence[str] | None = None
) -> DataFrame:
    """Full settings of the named variants: the base with (section, key) overrides.

    ``base``: section, key, value. ``overrides``: name, section, key, value. A name that
    is neither overridden nor "baseline" is an error. Overrides may add keys. Without
    ``names`` every overridden variant and the baseline are given (one name per experiment).
    """
    if names is None:
        found = overrides.select("name").distinct().filter("name <> 'baseline'")
        names = ["baseline", *sorted(r["name"] for r in found.collect())]
    listed = bounded_broadcast(overrides.select("name").distinct())
    wanted = base.sparkSession.createDataFrame([(n,) for n in names], "name string")
    unknown = [
        r["name"]
        for r in wanted.filter("name <> 'baseline'").join(listed, "name", "left_anti").collect()
    ]
    if unknown:
        raise ValueError(f"unknown experiments: {', '.join(sorted(unknown))}")
    copies = base.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names]))).select(
        "name", "section", "key", "value"
    )
    chosen = overrides.join(F.broadcast(wanted), "name", "left_semi").select(
        "name", "section", "key", F.col("value").alias("_new"), F.lit(True).alias("_set")
    )
    merged = copies.join(chosen, ["name", "section", "key"], "full")
    return merged.select(
        "name",
        "section",
        "key",
        F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value")).alias("value"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
