"""Evaluation, calibration and experiment queries over predictions derived from orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from splitwarden.functions import keys as KEYS
from splitwarden.functions import probs as P
from splitwarden.operators import calibration as C
from splitwarden.operators import experiments as E
from splitwarden.operators import metrics as M
from splitwarden.operators import roc as R
from splitwarden.plans import fixtures as X
from splitwarden.plans.fixtures import K_PRED as K
from splitwarden.plans.fixtures import round_cols

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(names, alias=None) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "confusion_matrix",
    f"WITH {X.PREDS_SQL}, {X.label_sql('split')} "
    "SELECT split, CAST(y_true AS INTEGER) AS y_true, CAST(y_pred AS INTEGER) AS y_pred, CAST(n AS BIGINT) AS n FROM cm",
)
def confusion(spark, sf):
    return M.confusion_matrix(X.predictions(spark, sf), K, ["split"])


PC_SQL = """CAST(c AS INTEGER) AS class_index, round(prec, 6) AS precision,
  round(rec, 6) AS recall_sensitivity, round(spec, 6) AS specificity, round(f1, 6) AS f1_score,
  CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS true_positive,
  CAST(fp AS BIGINT) AS false_positive, CAST(fn AS BIGINT) AS false_negative,
  CAST(tn AS BIGINT) AS true_negative"""


@query(
    "per_class_metrics",
    f"WITH {X.PREDS_SQL}, {X.label_sql('split')} SELECT split, {PC_SQL} FROM pc",
)
def per_class(spark, sf):
    cm = M.confusion_matrix(X.predictions(spark, sf), K, ["split"])
    return round_cols(M.per_class_metrics(cm, ["split"]))


@query(
    "scalar_metrics",
    f"WITH {X.PREDS_SQL}, {X.label_sql('split')} SELECT split, sample_count, correct_count, "
    + rounded(X.WIDE_METRICS[:12])
    + " FROM lab",
)
def scalar(spark, sf):
    cm = M.confusion_matrix(X.predictions(spark, sf), K, ["split"])
    return round_cols(M.label_scores(M.per_class_metrics(cm, ["split"]), ["split"]))


@query(
    "probability_scores",
    f"WITH {X.PREDS_SQL}, {X.prob_sql('split')} SELECT split, round(log_loss, 6) AS log_loss, "
    "round(brier_score_multiclass, 6) AS brier_score_multiclass, "
    "round(mean_confidence, 6) AS mean_confidence FROM pb",
)
def probability_scores(spark, sf):
    cube = M.metric_cube(X.predictions(spark, sf), K, ["split"])
    return round_cols(M.probability_scores(cube, ["split"]))


@query(
    "reliability_table",
    f"WITH {X.PREDS_SQL}, {X.prob_sql('split')} SELECT split, bin, CAST(n AS BIGINT) AS n, "
    "round(acc, 6) AS bin_accuracy, round(cf, 6) AS bin_confidence FROM rel",
)
def reliability(spark, sf):
    return round_cols(M.reliability(X.predictions(spark, sf), K, ["split"]))


@query(
    "expected_calibration_error",
    f"WITH {X.PREDS_SQL}, {X.prob_sql('split')} SELECT split, "
    "round(ece, 6) AS expected_calibration_error_10_bins FROM ec",
)
def ece(spark, sf):
    return round_cols(M.expected_calibration_error(X.predictions(spark, sf), K, ["split"]))


@query(
    "roc_auc_per_class",
    f"WITH {X.PREDS_SQL}, {X.prob_sql('split')} SELECT split, CAST(c AS INTEGER) AS class_index, "
    "CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, "
    "round(auc, 6) AS auc FROM au",
)
def auc_per_class(spark, sf):
    return round_cols(R.roc_auc_per_class(X.predictions(spark, sf), ["split"]))


@query(
    "roc_auc_ovr",
    f"WITH {X.PREDS_SQL}, {X.prob_sql('split')} SELECT split, "
    + rounded(["roc_auc_ovr_macro", "roc_auc_ovr_weighted"])
    + " FROM ar",
)
def auc(spark, sf):
    return round_cols(R.roc_auc_ovr(X.predictions(spark, sf), K, ["split"]))


@query(
    "roc_curve",
    f"""WITH {X.PREDS_SQL}, {X.prob_sql('split')}, pt AS (
  SELECT split, c, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY split, c) AS p, sum(neg) OVER (PARTITION BY split, c) AS n
  FROM gr WINDOW w AS (PARTITION BY split, c ORDER BY score DESC))
SELECT split, CAST(c AS INTEGER) AS class_index, round(score, 6) AS threshold,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / p, 6) AS tpr,
  round(fp / n, 6) AS fpr FROM pt""",
)
def roc(spark, sf):
    return round_cols(R.roc_curve(X.predictions(spark, sf), ["split"]))


@query(
    "metric_bundle",
    f"WITH {X.PREDS_SQL}, {X.bundle_sql('split')} SELECT split, sample_count, correct_count, "
    + rounded(X.WIDE_METRICS)
    + " FROM wide",
)
def bundle(spark, sf):
    return round_cols(M.metric_bundle(X.predictions(spark, sf), K, ["split"]))


@query(
    "metric_bundle_by_run_and_fold",
    f"WITH {X.PREDS_SQL}, {X.bundle_sql('experiment, seed, fold')} "
    "SELECT experiment, seed, fold, sample_count, correct_count, "
    + rounded(X.WIDE_METRICS)
    + " FROM wide",
)
def bundle_runs(spark, sf):
    by = ["experiment", "seed", "fold"]
    return round_cols(M.metric_bundle(X.predictions(spark, sf), K, by))


@query(
    "classification_report",
    f"""WITH {X.PREDS_SQL}, {X.label_sql('fold')},
rows AS (
  SELECT fold, c AS position, CAST(c AS VARCHAR) AS label, prec AS precision, rec AS recall,
         f1 AS f1_score, support FROM pc),
sums AS (
  SELECT fold, sum(tp) / sum(support) AS acc, avg(prec) AS mp, avg(rec) AS mr, avg(f1) AS mf,
    sum(prec * support) / sum(support) AS wp, sum(rec * support) / sum(support) AS wr,
    sum(f1 * support) / sum(support) AS wf, sum(support) AS support
  FROM pc GROUP BY fold),
allrows AS (
  SELECT * FROM rows
  UNION ALL SELECT fold, 5, 'accuracy', NULL, NULL, acc, support FROM sums
  UNION ALL SELECT fold, 6, 'macro avg', mp, mr, mf, support FROM sums
  UNION ALL SELECT fold, 7, 'weighted avg', wp, wr, wf, support FROM sums)
SELECT fold, CAST(position AS INTEGER) AS position, label, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, CAST(support AS BIGINT) AS support,
  fold AS fold_order FROM allrows""",
)
def report(spark, sf):
    return round_cols(
        M.combined_reports(X.predictions(spark, sf), K, "fold")
    )


@query(
    "with_prediction",
    f"WITH {X.PREDS_SQL} SELECT row_id, CAST(y_pred AS INTEGER) AS y_pred, "
    "round(conf, 6) AS confidence FROM pr",
)
def with_prediction(spark, sf):
    preds = M.with_prediction(X.predictions(spark, sf))
    return round_cols(preds.select("row_id", "y_pred", "confidence"))


@query(
    "display_confidence",
    f"""WITH {X.PREDS_SQL} SELECT row_id,
  round(least(greatest(conf * 2.2, 0), 0.999), 6) AS display_confidence,
  round(conf * 100, 6) AS confidence_percent,
  round(least(greatest(conf * 100 * 1.8, 0), 180), 6) AS gauge_degrees FROM pr""",
)
def display(spark, sf):
    preds = M.with_prediction(X.predictions(spark, sf))
    c = F.col("confidence")
    return round_cols(
        preds.select(
            "row_id",
            P.display_confidence(c * 2.2).alias("display_confidence"),
            P.confidence_percent(c).alias("confidence_percent"),
            P.gauge_degrees(c * 100).alias("gauge_degrees"),
        )
    )


@query(
    "one_hot_and_validation",
    f"""WITH {X.PREDS_SQL} SELECT row_id,
  concat_ws(',', CAST(y_true = 0 AS INTEGER), CAST(y_true = 1 AS INTEGER),
    CAST(y_true = 2 AS INTEGER), CAST(y_true = 3 AS INTEGER), CAST(y_true = 4 AS INTEGER)) AS one_hot,
  true AS valid, false AS valid_for_six FROM pr""",
)
def one_hot(spark, sf):
    preds = X.predictions(spark, sf)
    hot = F.transform(P.one_hot("y_true", K), lambda x: x.cast("int").cast("string"))
    return preds.select(
        "row_id",
        F.array_join(hot, ",").alias("one_hot"),
        P.valid_probs(F.col("probs"), K).alias("valid"),
        P.valid_probs(F.col("probs"), 6).alias("valid_for_six"),
    )


TEMPERATURE = 1.2334


def scaled_sql(t: float = TEMPERATURE) -> str:
    return f"""
lg AS (SELECT * EXCLUDE (probs, y_pred, conf),
         [ln(greatest(least(p, 1.0), 1e-8)) / {t} FOR p IN probs] AS z FROM pr),
ez AS (SELECT * EXCLUDE (z), list_max(z) AS top, [exp(x - list_max(z)) FOR x IN z] AS e FROM lg),
sp AS (SELECT * EXCLUDE (e, top), [x / list_sum(e) FOR x IN e] AS probs FROM ez)"""


@query(
    "apply_temperature",
    f"WITH {X.PREDS_SQL}, {scaled_sql()} SELECT row_id, "
    + ", ".join(f"round(probs[{i + 1}], 6) AS p{i}" for i in range(K))
    + " FROM sp",
)
def temperature(spark, sf):
    scaled = C.calibrate(X.predictions(spark, sf), TEMPERATURE)
    return round_cols(
        scaled.select("row_id", *[F.get("probs", i).alias(f"p{i}") for i in range(K)])
    )


@query(
    "calibration_comparison",
    f"""WITH {X.PREDS_SQL}, {scaled_sql()},
both_kinds AS (
  SELECT 'raw' AS probability_type, y_true, probs FROM pr
  UNION ALL SELECT 'temperature_scaled', y_true, probs FROM sp),
bk AS (SELECT *, list_position(probs, list_max(probs)) - 1 AS y_pred, list_max(probs) AS conf
       FROM both_kinds),
{X.bundle_sql('probability_type', 'bk')}
SELECT probability_type, sample_count, correct_count, """
    + rounded(X.WIDE_METRICS[:17])
    + " FROM wide",
)
def comparison(spark, sf):
    return round_cols(
        C.calibration_comparison(X.predictions(spark, sf), K, TEMPERATURE, with_auc=False)
    )


@query(
    "temperature_nll_grid",
    f"WITH {X.PREDS_SQL}, lg AS (SELECT y_true, [ln(greatest(least(p, 1.0), 1e-8)) FOR p IN probs] AS z FROM preds) "
    + " UNION ALL ".join(
        f"SELECT CAST({t} AS DOUBLE) AS temperature, round(avg(ln(list_sum([exp(x / {t}) FOR x IN z])) - z[y_true + 1] / {t}), 6) AS nll FROM lg"
        for t in (0.5, 1.0, 1.5, 3.0)
    ),
)
def nll_grid(spark, sf):
    logs = X.predictions(spark, sf).select("y_true", P.log_probs(F.col("probs")).alias("z"))
    points = (0.5, 1.0, 1.5, 3.0)
    sums = logs.agg(
        *[
            F.avg(C.scaled_nll("z", "y_true", K, 1.0 / t)).alias(f"v{i}")
            for i, t in enumerate(points)
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(t).alias("temperature"), F.col(f"v{i}").alias("nll"))
            for i, t in enumerate(points)
        ]
    )
    return round_cols(sums.select(F.explode(pairs).alias("p")).select("p.*"))


@query(
    "fit_temperature",
    f"WITH {X.PREDS_SQL} SELECT count(*) AS n, true AS inside, true AS least FROM preds WHERE split = 'validation'",
)
def fit(spark, sf):
    """The fitted temperature beats its neighbours on either side."""
    preds = X.predictions(spark, sf).filter("split = 'validation'")
    fitted = C.fit_temperature(preds, K)
    logs = preds.select("y_true", P.log_probs(F.col("probs")).alias("z"))
    points = (fitted, fitted * 0.999, fitted * 1.001)
    sums = logs.agg(
        F.count("*").alias("n"),
        *[F.avg(C.scaled_nll("z", "y_true", K, 1.0 / t)).alias(f"v{i}") for i, t in enumerate(points)],
    )
    inside = abs(math.log(fitted)) <= C.LOG_RANGE + 1e-9
    return sums.select(
        "n", F.lit(inside).alias("inside"), (F.col("v0") <= F.least("v1", "v2") + 1e-9).alias("least")
    )


GAP_PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]
HIGHER = ", ".join(f"'{m}'" for m in E.HIGHER_IS_BETTER)
DIRECTED = [*E.HIGHER_IS_BETTER, *E.LOWER_IS_BETTER]
GAPS_SQL = f"""
tl AS (UNPIVOT (SELECT split, {', '.join(DIRECTED)} FROM wide) ON {', '.join(DIRECTED)}
       INTO NAME metric VALUE value),
gp AS (
  SELECT a.split || '_vs_' || b.split AS comparison, a.metric, a.value AS first_value,
    b.value AS second_value,
    CASE WHEN a.metric IN ({HIGHER}) THEN a.value - b.value ELSE b.value - a.value END AS generalization_gap,
    abs(a.value - b.value) AS absolute_difference,
    CASE WHEN a.metric IN ({HIGHER}) THEN '{E.HIGHER_TEXT}' ELSE '{E.LOWER_TEXT}' END AS interpretation
  FROM tl a JOIN tl b ON a.metric = b.metric AND (a.split, b.split) IN
    (('train', 'validation'), ('train', 'test'), ('validation', 'test')))"""


@query(
    "metric_gaps",
    f"WITH {X.PREDS_SQL}, {X.bundle_sql('split')}, {GAPS_SQL} SELECT comparison, metric, "
    + rounded(["first_value", "second_value", "generalization_gap", "absolute_difference"])
    + ", interpretation FROM gp",
)
def gaps(spark, sf):
    wide = M.metric_bundle(X.predictions(spark, sf), K, ["split"])
    return round_cols(E.metric_gaps(M.tall(wide, ["split"]), GAP_PAIRS, "split"))


def fold_metrics(spark, sf):
    """Metrics per run, seed, fold and role: rows of the train and validation split."""
    preds = X.predictions(spark, sf).filter("split <> 'test'")
    by = ["experiment", "seed", "fold", "split"]
    wide = M.metric_bundle(preds, K, by)
    tall = M.tall(wide, by).withColumnRenamed("split", "role")
    return E.fold_results(tall, ["experiment", "seed", "fold"])


FOLD_SQL = f"""{X.PREDS_SQL}, tv AS (SELECT * FROM pr WHERE split <> 'test'),
{X.bundle_sql('experiment, seed, fold, split', 'tv')},
tl AS (UNPIVOT (SELECT experiment, seed, fold, split, {', '.join(X.WIDE_METRICS)} FROM wide)
       ON {', '.join(X.WIDE_METRICS)} INTO NAME metric VALUE value),
fr AS (
  SELECT experiment, seed, fold, split || '_' || metric AS metric, value FROM tl
  UNION ALL
  SELECT a.experiment, a.seed, a.fold, 'gap_' || a.metric,
    CASE WHEN a.metric IN ({HIGHER}) THEN a.value - b.value ELSE b.value - a.value END
  FROM tl a JOIN tl b USING (experiment, seed, fold, metric)
  WHERE a.split = 'train' AND b.split = 'validation' AND a.metric <> 'mean_confidence')"""


@query(
    "fold_results",
    f"WITH {FOLD_SQL} SELECT experiment, seed, fold, metric, round(value, 6) AS value FROM fr",
)
def fold_results(spark, sf):
    counts = ["train_sample_count", "train_correct_count", "validation_sample_count", "validation_correct_count"]
    scores = fold_metrics(spark, sf).filter(~F.col("metric").isin(counts))
    return round_cols(scores.filter("value IS NOT NULL"))


@query(
    "summarize_metrics",
    f"""WITH {FOLD_SQL}, sm AS (
  SELECT experiment, seed, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd,
    min(value) AS minimum, max(value) AS maximum, count(value) AS fold_count
  FROM fr GROUP BY ALL)
SELECT experiment, seed, metric, round(mean, 6) AS mean, round(sd, 6) AS standard_deviation,
  round(minimum, 6) AS minimum, round(maximum, 6) AS maximum,
  round(mean - 2.776 * sd / sqrt(fold_count), 6) AS ci95_lower,
  round(mean + 2.776 * sd / sqrt(fold_count), 6) AS ci95_upper,
  CAST(fold_count AS BIGINT) AS fold_count FROM sm""",
)
def summary(spark, sf):
    counts = ["train_sample_count", "train_correct_count", "validation_sample_count", "validation_correct_count"]
    tall = fold_metrics(spark, sf).filter(~F.col("metric").isin(counts))
    return round_cols(E.summarize_metrics(tall, ["experiment", "seed"]))


def _avg(metric: str, name: str) -> str:
    return f"round(avg(value) FILTER (metric = '{metric}'), 6) AS {name}"


@query(
    "leaderboard",
    f"WITH {FOLD_SQL} SELECT experiment, "
    + ", ".join(
        [
            _avg("validation_accuracy", "validation_accuracy_mean"),
            "round(stddev_samp(value) FILTER (metric = 'validation_accuracy'), 6) AS validation_accuracy_std",
            _avg("validation_f1_macro", "validation_f1_macro_mean"),
            "round(stddev_samp(value) FILTER (metric = 'validation_f1_macro'), 6) AS validation_f1_macro_std",
            _avg("validation_log_loss", "validation_log_loss_mean"),
            _avg("validation_roc_auc_ovr_macro", "validation_roc_auc_macro_mean"),
            _avg("gap_accuracy", "accuracy_gap_mean"),
            _avg("gap_f1_macro", "f1_gap_mean"),
        ]
    )
    + " FROM fr GROUP BY experiment ORDER BY 4 DESC, 2 DESC, 6 ASC",
)
def leaderboard(spark, sf):
    return round_cols(E.leaderboard(fold_metrics(spark, sf)))


CLASS_A, CLASS_B = 3, 4


def per_seed(spark, sf):
    preds = X.predictions(spark, sf)
    by = ["experiment", "seed"]
    confusion = M.confusion_matrix(preds.filter("split = 'validation'"), K, by)
    return E.seed_results(
        fold_metrics(spark, sf), M.per_class_metrics(confusion, by), confusion, CLASS_A, CLASS_B
    )


SEED_SQL = f"""{FOLD_SQL.replace('WITH ', '')},
va AS (SELECT * FROM pr WHERE split = 'validation'),
vc AS (SELECT experiment, seed, k.range AS c, sum(CAST(y_true = k.range AS INTEGER)) AS support,
         sum(CAST(y_pred = k.range AS INTEGER)) AS predicted,
         sum(CAST(y_true = k.range AND y_pred = k.range AS INTEGER)) AS tp
       FROM va, range({K}) k GROUP BY ALL),
ps AS (
  SELECT fr.experiment, fr.seed,
    avg(value) FILTER (metric = 'validation_accuracy') AS validation_accuracy_mean,
    avg(value) FILTER (metric = 'validation_f1_macro') AS validation_f1_macro_mean,
    avg(value) FILTER (metric = 'validation_log_loss') AS validation_log_loss_mean,
    avg(value) FILTER (metric = 'validation_roc_auc_ovr_macro') AS validation_roc_auc_macro_mean,
    avg(value) FILTER (metric = 'gap_accuracy') AS accuracy_gap_mean,
    avg(value) FILTER (metric = 'gap_f1_macro') AS f1_gap_mean
  FROM fr GROUP BY ALL),
er AS (
  SELECT experiment, seed, sum(CAST(y_true = {CLASS_A} AND y_pred = {CLASS_B} AS INTEGER)) AS ab,
    sum(CAST(y_true = {CLASS_B} AND y_pred = {CLASS_A} AS INTEGER)) AS ba FROM va GROUP BY ALL),
sd AS (
  SELECT ps.*, a.tp / a.support AS class_a_recall, 2.0 * a.tp / (a.support + a.predicted) AS class_a_f1,
    2.0 * b.tp / (b.support + b.predicted) AS class_b_f1, CAST(ab AS BIGINT) AS a_to_b_errors,
    CAST(ba AS BIGINT) AS b_to_a_errors, CAST(ab + ba AS BIGINT) AS total_errors
  FROM ps JOIN er USING (experiment, seed)
  JOIN vc a ON a.experiment = ps.experiment AND a.seed = ps.seed AND a.c = {CLASS_A}
  JOIN vc b ON b.experiment = ps.experiment AND b.seed = ps.seed AND b.c = {CLASS_B})"""
SEED_COLUMNS = [
    "validation_accuracy_mean",
    "validation_f1_macro_mean",
    "validation_log_loss_mean",
    "validation_roc_auc_macro_mean",
    "accuracy_gap_mean",
    "f1_gap_mean",
    "class_a_recall",
    "class_a_f1",
    "class_b_f1",
]


@query(
    "multiseed_per_seed",
    f"WITH {SEED_SQL} SELECT experiment, seed, {rounded(SEED_COLUMNS)}, a_to_b_errors, "
    "b_to_a_errors, total_errors, experiment || '_seed' || CAST(seed AS VARCHAR) AS run_name FROM sd",
)
def multiseed_rows(spark, sf):
    rows = per_seed(spark, sf)
    return round_cols(
        rows.withColumn("run_name", KEYS.run_name(F.col("experiment"), F.col("seed")))
    )


@query(
    "multiseed_summary",
    f"""WITH {SEED_SQL} SELECT experiment, count(*) AS seed_count,
  round(avg(validation_accuracy_mean), 6) AS accuracy_mean_across_seeds,
  round(stddev_samp(validation_accuracy_mean), 6) AS accuracy_std_across_seeds,
  round(avg(validation_f1_macro_mean), 6) AS macro_f1_mean_across_seeds,
  round(stddev_samp(validation_f1_macro_mean), 6) AS macro_f1_std_across_seeds,
  round(avg(validation_log_loss_mean), 6) AS log_loss_mean_across_seeds,
  round(avg(validation_roc_auc_macro_mean), 6) AS roc_auc_mean_across_seeds,
  round(avg(accuracy_gap_mean), 6) AS accuracy_gap_mean_across_seeds,
  round(avg(f1_gap_mean), 6) AS f1_gap_mean_across_seeds,
  round(avg(class_a_recall), 6) AS class_a_recall_mean,
  round(avg(class_a_f1), 6) AS class_a_f1_mean,
  round(avg(class_b_f1), 6) AS class_b_f1_mean,
  round(avg(total_errors), 6) AS total_errors_mean
FROM sd GROUP BY experiment""",
)
def multiseed(spark, sf):
    return round_cols(E.multiseed(per_seed(spark, sf)))


@query(
    "per_class_fold_summary",
    f"""WITH {X.PREDS_SQL}, {X.label_sql('fold')} SELECT CAST(c AS INTEGER) AS class_index,
  round(avg(prec), 6) AS precision_mean, round(stddev_samp(prec), 6) AS precision_std,
  round(avg(rec), 6) AS recall_mean, round(stddev_samp(rec), 6) AS recall_std,
  round(avg(spec), 6) AS specificity_mean, round(stddev_samp(spec), 6) AS specificity_std,
  round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std,
  CAST(sum(support) AS BIGINT) AS support_total FROM pc GROUP BY c""",
)
def class_summary(spark, sf):
    cm = M.confusion_matrix(X.predictions(spark, sf), K, ["fold"])
    return round_cols(E.per_class_summary(M.per_class_metrics(cm, ["fold"])))


@query(
    "select_candidate",
    f"""WITH {X.PREDS_SQL}, {X.bundle_sql('experiment, split')}, rk AS (
  SELECT *, row_number() OVER (PARTITION BY experiment
    ORDER BY f1_macro DESC, accuracy DESC, log_loss ASC, split ASC) AS r FROM wide)
SELECT experiment, split, round(f1_macro, 6) AS f1_macro, round(accuracy, 6) AS accuracy,
  round(log_loss, 6) AS log_loss, r = 1 AS selected FROM rk""",
)
def candidate(spark, sf):
    wide = M.metric_bundle(X.predictions(spark, sf), K, ["experiment", "split"], with_auc=False)
    chosen = E.select_candidate(wide, ["experiment"], "split")
    return round_cols(
        chosen.select("experiment", "split", "f1_macro", "accuracy", "log_loss", "selected")
    )


def history(spark, sf):
    e = X.table(spark, sf, "events")
    early = F.col("event_type").isin("signup", "view")
    return e.select(
        F.col("user_id").alias("run"),
        F.when(early, "frozen").otherwise("tuned").alias("phase"),
        F.when(early, 1).otherwise(2).alias("phase_order"),
        F.col("event_id").alias("epoch"),
        F.col("value").alias("loss"),
        (F.col("value") * 0.5 + F.col("event_id") % 7).alias("val_loss"),
        ((F.col("event_id") % 11) / 11).alias("accuracy"),
        ((F.col("event_id") % 13) / 13).alias("val_accuracy"),
    )


HISTORY_SQL = """
hi AS (
  SELECT user_id AS run, CASE WHEN event_type IN ('signup', 'view') THEN 'frozen' ELSE 'tuned' END AS phase,
    CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE 2 END AS phase_order, event_id AS epoch,
    value AS loss, value * 0.5 + event_id % 7 AS val_loss, (event_id % 11) / 11 AS accuracy,
    (event_id % 13) / 13 AS val_accuracy FROM events)"""


@query(
    "training_history",
    f"""WITH {HISTORY_SQL} SELECT run, phase, epoch,
  row_number() OVER (PARTITION BY run, phase_order ORDER BY epoch) AS phase_epoch,
  row_number() OVER (PARTITION BY run ORDER BY phase_order, epoch) AS global_epoch,
  round(accuracy - val_accuracy, 6) AS accuracy_gap_train_minus_validation,
  round(val_loss - loss, 6) AS loss_gap_validation_minus_train FROM hi""",
)
def training_history(spark, sf):
    return round_cols(
        E.history_table(history(spark, sf)).select(
            "run",
            "phase",
            "epoch",
            "phase_epoch",
            "global_epoch",
            "accuracy_gap_train_minus_validation",
            "loss_gap_validation_minus_train",
        )
    )


@query(
    "best_epoch",
    f"""WITH {HISTORY_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY run
  ORDER BY val_loss, phase_order, epoch) AS r FROM hi)
SELECT run, epoch AS best_epoch, round(val_loss, 6) AS best_val_loss FROM rk WHERE r = 1""",
)
def best_epoch(spark, sf):
    return round_cols(E.best_epoch(history(spark, sf)))


@query(
    "overlay_configs",
    """WITH b AS (
  SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS section, CAST(n_nationkey AS VARCHAR) AS value FROM nation),
nm AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION ALL SELECT 'baseline'),
ov AS (
  SELECT c_mktsegment AS name, n_name AS key, CAST(n_regionkey AS VARCHAR) AS section,
    CAST(count(*) AS VARCHAR) AS value
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT nm.name, section, key, coalesce(ov.value, b.value) AS value
FROM b CROSS JOIN nm LEFT JOIN ov USING (name, section, key)""",
)
def overlay(spark, sf):
    nation, customer = X.table(spark, sf, "nation"), X.table(spark, sf, "customer")
    base = nation.select(
        F.col("n_regionkey").cast("string").alias("section"),
        F.col("n_name").alias("key"),
        F.col("n_nationkey").cast("string").alias("value"),
    )
    over = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.col("c_mktsegment").alias("name"),
            F.col("n_regionkey").cast("string").alias("section"),
            F.col("n_name").alias("key"),
        )
        .agg(F.count("*").cast("string").alias("value"))
    )
    return E.overlay_configs(base, over)
