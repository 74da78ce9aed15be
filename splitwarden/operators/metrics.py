"""Classifier metrics for any number of splits, folds or runs in one job.

Rows are reduced once to a *cube*: one row per (keys, true class, predicted class,
confidence bin) with a count and a few sums. Confusion matrix, per-class scores, the
scalar scores, log loss, Brier and calibration error are all derived from the cube, whose
size depends on the class count and not on the data. Only ROC needs the scores again.

A prediction row has ``y_true INT`` and ``probs ARRAY<DOUBLE>``; ``y_pred`` is derived.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitwarden.functions import probs as P
from splitwarden.operators.roc import roc_auc_ovr
from splitwarden.operators.scale import materialise

# Fixed value: probabilities are clipped to [EPS, 1 - EPS] before the logarithm.
LOG_LOSS_EPS = 2.220446049250313e-16
ECE_BINS = 10
# Up to this many classes a key's counts are one row of arrays, built by a single shuffle.
UNROLL_CELLS = 12
UNROLL_CLASSES = 32

COUNT_METRICS = ["sample_count", "correct_count"]
SCORE_METRICS = [
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
    "log_loss",
    "brier_score_multiclass",
    "mean_confidence",
    "confidence_accuracy_gap",
]
AUC_METRICS = ["roc_auc_ovr_macro", "roc_auc_ovr_weighted"]


def ece_name(bins: int = ECE_BINS) -> str:
    return f"expected_calibration_error_{bins}_bins"


def metric_names(bins: int = ECE_BINS) -> list[str]:
    return [*COUNT_METRICS, *SCORE_METRICS, ece_name(bins), *AUC_METRICS]


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient where a zero denominator counts as 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))


def with_prediction(df: DataFrame) -> DataFrame:
    """Add ``y_pred`` (first maximum) and ``confidence`` (clipped maximum)."""
    return df.withColumns(
        {
            "y_pred": P.predicted_index(F.col("probs")),
            "confidence": P.confidence(F.col("probs")),
        }
    )


def known_labels(df: DataFrame, k: int) -> DataFrame:
    """Rows whose truth and prediction are classes 0..k-1.

    A NULL label or one outside that range belongs to no class: no metric counts the row,
    whatever the number of classes.
    """
    return df.filter(F.col("y_true").between(0, k - 1) & F.col("y_pred").between(0, k - 1))


def metric_cube(
    preds: DataFrame, k: int, by: Sequence[str] = (), bins: int = ECE_BINS
) -> DataFrame:
    probs, label = F.col("probs"), F.col("y_true")
    hit = F.least(
        F.greatest(P.true_probability(probs, label), F.lit(LOG_LOSS_EPS)),
        F.lit(1.0 - LOG_LOSS_EPS),
    )
    scored = preds.select(
        *by,
        "y_true",
        P.predicted_index(probs).alias("y_pred"),
        F.array_max(probs).alias("conf"),
        (-F.log(hit)).alias("loss"),
        P.squared_error("probs", "y_true", k).alias("sq"),
    )
    return (
        known_labels(scored, k)
        .withColumn("bin", P.confidence_bin("conf", bins))
        .groupBy(*by, "y_true", "y_pred", "bin")
        .agg(
            F.count("*").alias("n"),
            F.sum("loss").alias("loss"),
            F.sum("sq").alias("sq"),
            F.sum("conf").alias("conf"),
        )
    )


def confusion_from_cube(cube: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Dense k x k counts per key: missing cells are emitted as zero."""
    by = list(by)
    if k <= UNROLL_CELLS:
        cells = ", ".join(
            f"coalesce(sum(n) FILTER (WHERE y_true = {t} AND y_pred = {p}), 0L)"
            for t in range(k)
            for p in range(k)
        )
        packed = cube.groupBy(*by).agg(F.expr(f"array({cells})").alias("_cells"))
        return packed.select(*by, F.posexplode("_cells").alias("_at", "n")).select(
            *by,
            F.floor(F.col("_at") / k).cast("int").alias("y_true"),
            (F.col("_at") % k).cast("int").alias("y_pred"),
            "n",
        )
    seen = cube.groupBy(*by, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    labels = F.sequence(F.lit(0), F.lit(k - 1))
    keys = cube.groupBy(*by).agg(F.first("n").alias("_any")).drop("_any")
    zeros = (
        keys.select(*by, F.explode(labels).alias("y_true"))
        .select(*by, "y_true", F.explode(labels).alias("y_pred"))
        .withColumn("n", F.lit(0).cast("bigint"))
    )
    return (
        seen.unionByName(zeros).groupBy(*by, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    )


def confusion_matrix(preds: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Dense counts; accepts rows with ``y_pred`` or with ``probs`` only."""
    if "y_pred" not in preds.columns:
        preds = preds.withColumn("y_pred", P.predicted_index(F.col("probs")))
    cells = known_labels(preds, k).groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    return confusion_from_cube(cells, k, by)


def per_class_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp / fp / fn / tn and scores per class, from a dense confusion matrix."""
    if not by:
        keyed = confusion.withColumn("_all", F.lit(0))
        return per_class_metrics(keyed, ["_all"]).drop("_all")
    by = list(by)
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            t.alias("class_index"),
            n.alias("support"),
            zero.alias("predicted"),
            F.when(t == p, n).otherwise(zero).alias("tp"),
        ),
        F.struct(
            p.alias("class_index"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")
        ),
    )
    margins = (
        confusion.select(*by, F.explode(sides).alias("s"))
        .select(*by, "s.*")
        .groupBy(*by, "class_index")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    # A key has few class rows, so the total over them is a small window.
    joined = margins.withColumn("total", F.sum("support").over(Window.partitionBy(*by)))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    fp, fn = predicted - tp, support - tp
    tn = F.col("total") - support - fp
    return joined.select(
        *by,
        "class_index",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall_sensitivity"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(tp * 2, support + predicted).alias("f1_score"),
        support.alias("support"),
        tp.alias("true_positive"),
        fp.alias("false_positive"),
        fn.alias("false_negative"),
        tn.alias("true_negative"),
    )


def label_scores(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All scores that depend on the confusion counts only, one row per key.

    Macro precision, recall and F1 average the classes seen in truth or prediction;
    balanced accuracy averages those seen in truth; macro specificity averages all.
    """
    tp, support = F.col("true_positive"), F.col("support")
    predicted = tp + F.col("false_positive")
    present = (support > 0) | (predicted > 0)

    def macro(name: str) -> Column:
        return F.avg(F.when(present, F.col(name)))

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * support) / F.sum(support)

    sums = per_class.groupBy(*by).agg(
        F.sum(support).alias("sample_count"),
        F.sum(tp).alias("correct_count"),
        F.avg(F.when(support > 0, F.col("recall_sensitivity"))).alias("balanced_accuracy"),
        macro("precision").alias("precision_macro"),
        macro("recall_sensitivity").alias("recall_macro"),
        macro("f1_score").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall_sensitivity").alias("recall_weighted"),
        weighted("f1_score").alias("f1_weighted"),
        F.avg("specificity").alias("specificity_macro"),
        weighted("specificity").alias("specificity_weighted"),
        F.sum(support.cast("double") * predicted).alias("_tp"),
        F.sum(support.cast("double") * support).alias("_tt"),
        F.sum(predicted.cast("double") * predicted).alias("_pp"),
    )
    s, c = F.col("sample_count").cast("double"), F.col("correct_count").cast("double")
    chance = F.col("_tp") / (s * s)
    spread = (s * s - F.col("_pp")) * (s * s - F.col("_tt"))
    return sums.withColumns(
        {
            "accuracy": c / s,
            "cohen_kappa": F.when(chance < 1, (c / s - chance) / (1 - chance)),
            "matthews_correlation_coefficient": F.when(spread == 0, F.lit(0.0)).otherwise(
                (c * s - F.col("_tp")) / F.sqrt(F.nullif(spread, F.lit(0.0)))
            ),
        }
    ).drop("_tp", "_tt", "_pp")


def probability_scores(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log loss, Brier score and mean confidence per key."""
    n = F.sum("n")
    return cube.groupBy(*by).agg(
        (F.sum("loss") / n).alias("log_loss"),
        (F.sum("sq") / n).alias("brier_score_multiclass"),
        (F.sum("conf") / n).alias("mean_confidence"),
    )


def reliability_from_cube(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hits = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    n = F.sum("n")
    return cube.groupBy(*by, "bin").agg(
        n.alias("n"),
        (hits / n).alias("bin_accuracy"),
        (F.sum("conf") / n).alias("bin_confidence"),
    )


def reliability(
    preds: DataFrame, k: int, by: Sequence[str] = (), bins: int = ECE_BINS
) -> DataFrame:
    """Reliability table: rows, accuracy and mean confidence of each non-empty bin."""
    return reliability_from_cube(metric_cube(preds, k, by, bins), by)


def ece_from_reliability(
    table: DataFrame, by: Sequence[str] = (), name: str = "ece"
) -> DataFrame:
    gap = F.abs(F.col("bin_accuracy") - F.col("bin_confidence"))
    return table.groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias(name))


def expected_calibration_error(
    preds: DataFrame, k: int, by: Sequence[str] = (), bins: int = ECE_BINS
) -> DataFrame:
    return ece_from_reliability(reliability(preds, k, by, bins), by, ece_name(bins))


def key_profile(cube: DataFrame, k: int, by: Sequence[str], bins: int = ECE_BINS) -> DataFrame:
    """One row per key with the margins, the diagonal and the bin sums as arrays."""

    def sums(value: str, zero: str, conditions: Sequence[str]) -> Column:
        cells = [f"coalesce(sum({value}) FILTER (WHERE {c}), {zero})" for c in conditions]
        return F.expr(f"array({', '.join(cells)})")

    return cube.groupBy(*by).agg(
        sums("n", "0L", [f"y_true = {i}" for i in range(k)]).alias("support"),
        sums("n", "0L", [f"y_pred = {i}" for i in range(k)]).alias("predicted"),
        sums("n", "0L", [f"y_true = {i} AND y_pred = {i}" for i in range(k)]).alias("tp"),
        sums("n", "0L", [f"bin = {i} AND y_true = y_pred" for i in range(bins)]).alias(
            "bin_hits"
        ),
        sums("conf", "0D", [f"bin = {i}" for i in range(bins)]).alias("bin_conf"),
        F.sum("n").alias("total"),
        (F.sum("loss") / F.sum("n")).alias("log_loss"),
        (F.sum("sq") / F.sum("n")).alias("brier_score_multiclass"),
        (F.sum("conf") / F.sum("n")).alias("mean_confidence"),
    )


def bundle_from_profile(profile: DataFrame, k: int, by: Sequence[str], bins: int) -> DataFrame:
    """Every metric except the areas, by array expressions on one profile row per key."""
    add = "CAST(0 AS DOUBLE), (acc, x) -> acc + x"
    ratio = lambda a, b: f"CASE WHEN {b} = 0 THEN 0D ELSE {a} / nullif({b}, 0) END"
    scored = profile.withColumn(
        "c",
        F.expr(
            "transform(arrays_zip(support, predicted, tp), c -> named_struct("
            "'w', c.support, 'p', c.predicted, 'hit', c.tp, "
            f"'precision', {ratio('c.tp', 'c.predicted')}, "
            f"'recall', {ratio('c.tp', 'c.support')}, "
            f"'f1', {ratio('(2 * c.tp)', '(c.support + c.predicted)')}, "
            # True negatives over all negatives of the class.
            f"'spec', {ratio('(total - c.support - c.predicted + c.tp)', '(total - c.support)')}))"
        ),
    )

    def total(value: str) -> str:
        return f"aggregate(transform(c, x -> CAST({value} AS DOUBLE)), {add})"

    def macro(score: str, kept: str) -> str:
        return f"{total(f'CASE WHEN {kept} THEN x.{score} ELSE 0D END')} / {total(f'CASE WHEN {kept} THEN 1 ELSE 0 END')}"

    def weighted(score: str) -> str:
        return f"{total(f'x.{score} * x.w')} / total"

    present, in_truth, every = "(x.w > 0 OR x.p > 0)", "x.w > 0", "true"
    off = "aggregate(zip_with(bin_hits, bin_conf, (h, f) -> abs(h - f)), " + add + ")"
    values = {
        "sample_count": "total",
        "correct_count": f"CAST({total('x.hit')} AS BIGINT)",
        "accuracy": f"{total('x.hit')} / total",
        "balanced_accuracy": macro("recall", in_truth),
        "precision_macro": macro("precision", present),
        "recall_macro": macro("recall", present),
        "f1_macro": macro("f1", present),
        "precision_weighted": weighted("precision"),
        "recall_weighted": weighted("recall"),
        "f1_weighted": weighted("f1"),
        "specificity_macro": macro("spec", every),
        "specificity_weighted": weighted("spec"),
        ece_name(bins): f"{off} / total",
        "_tp": total("CAST(x.w AS DOUBLE) * x.p"),
        "_tt": total("CAST(x.w AS DOUBLE) * x.w"),
        "_pp": total("CAST(x.p AS DOUBLE) * x.p"),
    }
    base = scored.selectExpr(
        *by,
        "log_loss",
        "brier_score_multiclass",
        "mean_confidence",
        *[f"{text} AS {name}" for name, text in values.items()],
    )
    n = "CAST(sample_count AS DOUBLE)"
    chance = f"(_tp / ({n} * {n}))"
    spread = f"(({n} * {n} - _pp) * ({n} * {n} - _tt))"
    return base.selectExpr(
        "*",
        "mean_confidence - accuracy AS confidence_accuracy_gap",
        f"CASE WHEN {chance} < 1 THEN (accuracy - {chance}) / (1 - {chance}) END AS cohen_kappa",
        f"CASE WHEN {spread} = 0 THEN 0D ELSE (correct_count * {n} - _tp) / sqrt(nullif({spread}, 0D)) END"
        " AS matthews_correlation_coefficient",
    ).drop("_tp", "_tt", "_pp")


def metric_bundle(
    preds: DataFrame,
    k: int,
    by: Sequence[str] = (),
    bins: int = ECE_BINS,
    with_auc: bool = True,
) -> DataFrame:
    """Every scalar metric, one wide row per key (split, fold, run, probability type)."""
    if not by:
        keyed = preds.withColumn("_all", F.lit(0))
        return metric_bundle(keyed, k, ["_all"], bins, with_auc).drop("_all")
    by = list(by)
    cube = metric_cube(preds, k, by, bins)
    if k <= UNROLL_CLASSES:
        wide = bundle_from_profile(key_profile(cube, k, by, bins), k, by, bins)
    else:
        cube = materialise(cube, "cube")
        per_class = per_class_metrics(confusion_from_cube(cube, k, by), by)
        wide = label_scores(per_class, by).join(probability_scores(cube, by), by)
        wide = wide.join(
            ece_from_reliability(reliability_from_cube(cube, by), by, ece_name(bins)), by
        ).withColumn(
            "confidence_accuracy_gap", F.col("mean_confidence") - F.col("accuracy")
        )
    if with_auc:
        wide = wide.join(roc_auc_ovr(preds, k, by), by)
    names = [n for n in metric_names(bins) if with_auc or n not in AUC_METRICS]
    return wide.select(*by, *names)


def tall(wide: DataFrame, by: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One row per (key, metric); NULL values are kept."""
    names = list(names or [c for c in wide.columns if c not in by])
    doubles = wide.select(*by, *[F.col(n).cast("double").alias(n) for n in names])
    if not by:
        doubles = doubles.withColumn("_one", F.lit(1))
        return doubles.unpivot(["_one"], names, "metric", "value").drop("_one")
    return doubles.unpivot(list(by), names, "metric", "value")


def classification_report(
    preds: DataFrame, k: int, by: Sequence[str] = ()
) -> DataFrame:
    """Per-class rows followed by accuracy, macro avg and weighted avg.

    The averages cover all ``k`` labels, as a report over a fixed label list does.
    """
    by = list(by)
    per_class = per_class_metrics(confusion_matrix(preds, k, by), by)
    scores = ["precision", "recall_sensitivity", "f1_score"]
    renamed = ["precision", "recall", "f1_score"]
    rows = per_class.select(
        *by,
        F.col("class_index").alias("position"),
        F.col("class_index").cast("string").alias("label"),
        *[F.col(a).alias(b) for a, b in zip(scores, renamed)],
        "support",
    )
    support = F.sum("support")
    macro = [F.avg(a).alias(f"m_{b}") for a, b in zip(scores, renamed)]
    weighted = [
        (F.sum(F.col(a) * F.col("support")) / support).alias(f"w_{b}")
        for a, b in zip(scores, renamed)
    ]
    sums = per_class.groupBy(*by).agg(
        (F.sum("true_positive") / support).alias("acc"),
        *macro,
        *weighted,
        support.alias("support"),
    )

    def line(position: int, label: str, values: list[Column]) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(label).alias("label"),
            *[v.alias(b) for v, b in zip(values, renamed)],
            F.col("support").alias("support"),
        )

    none = F.lit(None).cast("double")
    lines = F.array(
        line(k, "accuracy", [none, none, F.col("acc")]),
        line(k + 1, "macro avg", [F.col(f"m_{b}") for b in renamed]),
        line(k + 2, "weighted avg", [F.col(f"w_{b}") for b in renamed]),
    )
    tail = sums.select(*by, F.explode(lines).alias("l")).select(*by, "l.*")
    return rows.unionByName(tail)


def combined_reports(
    preds: DataFrame, k: int, fold_name: str, by: Sequence[str] = ()
) -> DataFrame:
    """Reports of all folds with a sort key: fold number, or 999 for a non-numeric fold."""
    report = classification_report(preds, k, [*by, fold_name])
    digits = F.regexp_extract(F.col(fold_name), r"^(?:fold_)?(-?\d+)$", 1)
    number = F.coalesce(digits.try_cast("int"), F.lit(999))
    return report.withColumn("fold_order", number)
