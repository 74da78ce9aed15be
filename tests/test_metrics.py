import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwarden.functions import probs as P
from splitwarden.operators import calibration as C
from splitwarden.operators import metrics as M
from splitwarden.operators import roc as R

# A published 6 x 6 matrix: rows are truth, columns predictions.
MATRIX = [
    [30, 0, 0, 0, 0, 0],
    [0, 28, 0, 2, 0, 0],
    [0, 2, 28, 0, 0, 0],
    [0, 0, 0, 25, 5, 0],
    [0, 0, 0, 1, 29, 0],
    [0, 0, 0, 0, 0, 30],
]


def from_matrix(spark, matrix):
    rows = [(t, p) for t, r in enumerate(matrix) for p, n in enumerate(r) for _ in range(n)]
    return spark.createDataFrame(rows, "y_true int, y_pred int")


def test_published_matrix(spark):
    confusion = M.confusion_matrix(from_matrix(spark, MATRIX), 6)
    assert confusion.count() == 36
    row = M.label_scores(M.per_class_metrics(confusion)).first()
    assert row["sample_count"] == 180 and row["correct_count"] == 170
    expected = {
        "accuracy": 0.9444,
        "precision_macro": 0.9465,
        "recall_macro": 0.9444,
        "f1_macro": 0.9445,
        "specificity_macro": 0.9889,
        "cohen_kappa": 0.9333,
        "matthews_correlation_coefficient": 0.9337,
    }
    for name, value in expected.items():
        assert abs(row[name] - value) < 5e-5, name


def random_preds(spark, n=400, k=4, seed=3, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        raw = [rng.randint(1, 6) if ties else rng.random() for _ in range(k)]
        total = sum(raw)
        rows.append((i, rng.randrange(k), [float(x) / total for x in raw], "ab"[i % 2]))
    return rows, spark.createDataFrame(rows, "row_id int, y_true int, probs array<double>, part string")


def test_probability_scores_against_numpy(spark):
    rows, df = random_preds(spark)
    y = np.array([r[1] for r in rows])
    p = np.array([r[2] for r in rows])
    got = M.metric_bundle(df, 4).first()
    eps = np.finfo(float).eps
    picked = np.clip(p[np.arange(len(y)), y], eps, 1 - eps)
    assert math.isclose(got["log_loss"], -np.log(picked).mean(), rel_tol=1e-9)
    hot = np.eye(4)[y]
    assert math.isclose(got["brier_score_multiclass"], ((p - hot) ** 2).sum(1).mean(), rel_tol=1e-9)
    conf, hit = p.max(1), p.argmax(1) == y
    edges, error = np.linspace(0, 1, 11), 0.0
    for i in range(10):
        upper = conf <= edges[i + 1] if i == 9 else conf < edges[i + 1]
        mask = (conf >= edges[i]) & upper
        if mask.any():
            error += mask.mean() * abs(hit[mask].mean() - conf[mask].mean())
    assert math.isclose(got["expected_calibration_error_10_bins"], error, abs_tol=1e-9)
    areas = []
    for c in range(4):
        pos, neg = p[y == c, c], p[y != c, c]
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        areas.append(wins / (len(pos) * len(neg)))
    assert math.isclose(got["roc_auc_ovr_macro"], np.mean(areas), rel_tol=1e-9)


def test_both_bundle_paths_agree(spark, monkeypatch):
    _, df = random_preds(spark)
    short = M.metric_bundle(df, 4, ["part"]).orderBy("part").collect()
    monkeypatch.setattr(M, "UNROLL_CLASSES", 1)
    monkeypatch.setattr(M, "UNROLL_CELLS", 1)
    monkeypatch.setattr(P, "UNROLL", 1)
    long = M.metric_bundle(df, 4, ["part"]).orderBy("part").collect()
    for a, b in zip(short, long):
        for name in M.metric_names():
            assert math.isclose(a[name], b[name], rel_tol=1e-9, abs_tol=1e-12), name


def test_absent_class_and_undefined_area(spark):
    df = spark.createDataFrame(
        [(0, [0.6, 0.3, 0.1]), (0, [0.2, 0.7, 0.1]), (1, [0.1, 0.8, 0.1])],
        "y_true int, probs array<double>",
    )
    row = M.metric_bundle(df, 3).first()
    assert row["roc_auc_ovr_macro"] is None
    # Class 2 is in neither truth nor prediction: macro scores average two classes only.
    assert math.isclose(row["recall_macro"], (0.5 + 1.0) / 2)
    assert math.isclose(row["specificity_macro"], (1.0 + 0.5 + 1.0) / 3)


def test_first_maximum_wins_ties(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "probs array<double>")
    assert M.with_prediction(df).first()["y_pred"] == 0


def test_bins_use_edges(spark):
    df = spark.createDataFrame([(0.30000000000000004,), (0.3,), (1.0,), (0.0,)], "c double")
    bins = [r[0] for r in df.select(P.confidence_bin("c", 10)).collect()]
    assert bins == [3, 2, 9, 0]


def test_reversed_scores_mirror_the_area(spark):
    rows, df = random_preds(spark)
    flipped = df.withColumn("probs", F.transform("probs", lambda x: 1 - x))
    a = {r["class_index"]: r["auc"] for r in R.roc_auc_per_class(df).collect()}
    b = {r["class_index"]: r["auc"] for r in R.roc_auc_per_class(flipped).collect()}
    for c in a:
        assert math.isclose(a[c], 1 - b[c], abs_tol=1e-9)


def test_temperature_fit(spark):
    rng = np.random.default_rng(5)
    logits = rng.normal(size=(600, 4)) * 2
    soft = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = [int(rng.choice(4, p=row)) for row in soft]
    sharp = np.exp(logits * 3) / np.exp(logits * 3).sum(1, keepdims=True)
    df = spark.createDataFrame(
        [(t, [float(x) for x in p]) for t, p in zip(y, sharp)], "y_true int, probs array<double>"
    )
    best = C.fit_temperature(df, 4)
    assert 2.4 < best < 3.6
    low, mid, high = C.nll_at(df, 4, [best * 0.98, best, best * 1.02])
    assert mid <= low and mid <= high


def test_temperature_keeps_order_and_sum(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1, 0.0],)], "probs array<double>")
    with pytest.raises(ValueError):
        C.calibrate(df, 0.0)
    row = C.calibrate(df, 0.001).first()["probs"]
    assert math.isclose(sum(row), 1.0) and row[0] > 0.999
    logs = np.log(np.clip([0.7, 0.2, 0.1, 0.0], 1e-8, 1)) / 1.7
    want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    assert np.allclose(C.calibrate(df, 1.7).first()["probs"], want)


@pytest.mark.parametrize("shape", [(8, 8, 5, 7), (8, 8, 11, 13), (1, 3, 4, 2), (6, 5, 6, 5)])
def test_native_resize_equals_the_pixel_kernel(spark, shape):
    import numpy as np

    from splitwarden.functions import grids as G
    from splitwarden.operators.images import bilinear

    rows, cols, new_rows, new_cols = shape
    values = np.random.default_rng(3).random(rows * cols)
    df = spark.createDataFrame([(values.tolist(),)], "grid array<double>")
    found = df.select(G.resize("grid", *shape).alias("g")).first()["g"]
    assert np.allclose(found, bilinear(values.reshape(rows, cols, 1), new_rows, new_cols)[:, :, 0].ravel(), atol=1e-6)
