"""Temperature scaling: fit, apply, compare raw with scaled."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.functions import probs as P
from splitwarden.functions.sqltext import plus
from splitwarden.operators.metrics import metric_bundle
from splitwarden.operators.scale import materialise

# Fixed value: the fit moves the log temperature by at most 3 from zero.
LOG_RANGE = 3.0
TOLERANCE = 1e-7
MAX_STEPS = 60


def scaled_nll(logs: str, label: str, k: int, inverse: float) -> Column:
    """Cross-entropy of softmax(logs / T) at ``inverse`` = 1 / T; arguments are column names."""
    parts = [f"get({logs}, {i})" for i in range(k)]
    top = f"array_max({logs})"
    total = plus(f"exp(({x} - {top}) * {inverse!r}D)" for x in parts)
    return F.expr(f"ln({total}) - (get({logs}, {label}) - {top}) * {inverse!r}D")


def nll_at(preds: DataFrame, k: int, temperatures: Sequence[float]) -> list[float]:
    """Mean cross-entropy at several temperatures in one pass."""
    logs = preds.select("y_true", P.log_probs(F.col("probs")).alias("logs"))
    row = logs.agg(
        *[
            F.avg(scaled_nll("logs", "y_true", k, 1.0 / t)).alias(f"v{i}")
            for i, t in enumerate(temperatures)
        ]
    ).first()
    return [row[f"v{i}"] for i in range(len(temperatures))]


def _slopes(logs: DataFrame, k: int, inverse: float) -> tuple[float, float]:
    """First and second derivative of the mean cross-entropy in b = 1 / T, one aggregate."""
    zero = "named_struct('z', 0D, 'm', 0D, 'q', 0D)"
    power = f"exp((x - top) * {inverse!r}D)"
    if k <= P.UNROLL:
        parts = [f"get(logs, {i})" for i in range(k)]
        powers = [power.replace("x - top", f"{x} - top") for x in parts]
        pairs = list(zip(powers, parts))
        sums = logs.selectExpr("y_true", "logs", "array_max(logs) AS top").selectExpr(
            "y_true",
            "logs",
            f"{plus(powers)} AS z",
            f"{plus(f'{p} * {x}' for p, x in pairs)} AS m",
            f"{plus(f'{p} * {x} * {x}' for p, x in pairs)} AS q",
        )
    else:
        step = (
            f"(a, x) -> named_struct('z', a.z + {power}, 'm', a.m + {power} * x, "
            f"'q', a.q + {power} * x * x)"
        )
        sums = (
            logs.selectExpr("y_true", "logs", "array_max(logs) AS top")
            .selectExpr("y_true", "logs", f"aggregate(logs, {zero}, {step}) AS a")
            .selectExpr("y_true", "logs", "a.z", "a.m", "a.q")
        )
    mean = F.col("m") / F.col("z")
    row = sums.agg(
        F.avg(mean - F.get("logs", "y_true")).alias("first"),
        F.avg(F.col("q") / F.col("z") - mean * mean).alias("second"),
    ).first()
    return row["first"], row["second"]


def fit_temperature(preds: DataFrame, k: int) -> float:
    """Temperature with the least mean cross-entropy, log T within +-``LOG_RANGE``.

    The loss is convex in b = 1 / T, so its slope has one sign change: Newton steps on b,
    replaced by a halving of the bracket whenever a step leaves it. Each step is one
    aggregate of two numbers over the whole table.
    """
    logs = materialise(
        preds.select("y_true", P.log_probs(F.col("probs")).alias("logs")), "calibration"
    )
    low, high = math.exp(-LOG_RANGE), math.exp(LOG_RANGE)
    inverse = 1.0
    for _ in range(MAX_STEPS):
        slope, bend = _slopes(logs, k, inverse)
        if slope is None:
            raise ValueError("no predictions to fit a temperature on")
        if slope > 0:
            high = inverse
        else:
            low = inverse
        step = inverse - slope / bend if bend and bend > 0 else low
        following = step if low < step < high else math.sqrt(low * high)
        if abs(math.log(following / inverse)) < TOLERANCE:
            return 1.0 / following
        inverse = following
    raise RuntimeError(f"the temperature did not settle in {MAX_STEPS} steps")


def at_bound(temperature: float) -> bool:
    """Whether a fitted temperature stands at the end of the allowed range."""
    return abs(abs(math.log(temperature)) - LOG_RANGE) < 1e-4


def calibrate(preds: DataFrame, temperature: float | Column) -> DataFrame:
    return preds.withColumn("probs", P.apply_temperature(F.col("probs"), temperature))


def calibration_comparison(
    preds: DataFrame, k: int, temperature: float, by: Sequence[str] = (), with_auc: bool = True
) -> DataFrame:
    """Metric rows of the raw and the scaled probabilities, from one union."""
    typed = preds.withColumn("probability_type", F.lit("raw")).unionByName(
        calibrate(preds, temperature).withColumn(
            "probability_type", F.lit("temperature_scaled")
        )
    )
    return metric_bundle(typed, k, [*by, "probability_type"], with_auc=with_auc)
