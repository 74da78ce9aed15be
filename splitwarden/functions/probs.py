"""Probability vectors: arg-max, calibration, validation, one-hot and display values.

Functions that take the class count ``k`` unroll small vectors into plain arithmetic so
they stay inside generated code; longer vectors use array functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitwarden.functions.sqltext import plus

UNROLL = 32

# Fixed values.
CONFIDENCE_CAP = 0.999
LOG_FLOOR = 1e-8
GAUGE_DEGREES = 180.0


def predicted_index(probs: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    return F.least(F.greatest(F.array_max(probs), F.lit(0.0)), F.lit(1.0))


def display_confidence(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(CONFIDENCE_CAP))


def confidence_percent(value: Column) -> Column:
    return F.round(value * 100, 6)


def display_percent(value: Column) -> Column:
    return F.round(display_confidence(value) * 100, 1)


def gauge_degrees(percent: Column) -> Column:
    """Percent to a half-circle angle; NULL, NaN and infinities count as zero."""
    finite = F.when(
        F.isnan(percent) | (F.abs(percent) == float("inf")), F.lit(0.0)
    ).otherwise(F.coalesce(percent, F.lit(0.0)))
    return F.least(F.greatest(finite * 1.8, F.lit(0.0)), F.lit(GAUGE_DEGREES))


def one_hot(label: str, k: int) -> Column:
    """``label`` is a column name."""
    cells = ", ".join(f"CAST({label} = {i} AS DOUBLE)" for i in range(k))
    return F.expr(f"array({cells})")


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside array lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _clip(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(LOG_FLOOR)), F.lit(1.0))


def log_probs(probs: Column) -> Column:
    return F.transform(probs, lambda p: F.log(_clip(p)))


def apply_temperature(probs: Column, temperature: float | Column) -> Column:
    """Softmax of the clipped log-probabilities divided by ``temperature``.

    exp((ln p - ln max) / t) is (p / max)^(1 / t), which needs one power per class.
    """
    if isinstance(temperature, (int, float)) and temperature <= 0:
        raise ValueError("temperature must be greater than zero")
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    raised = _bind(
        _clip(F.array_max(probs)),
        lambda top: F.transform(probs, lambda p: F.pow(_clip(p) / top, F.lit(1.0) / t)),
    )
    return _bind(
        raised,
        lambda r: _bind(
            F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x),
            lambda total: F.transform(r, lambda x: x / total),
        ),
    )


def valid_probs(probs: Column, k: int) -> Column:
    """True for a vector of exactly ``k`` finite numbers."""
    finite = F.forall(
        probs, lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    )
    return F.coalesce((F.size(probs) == k) & finite, F.lit(False))


def true_probability(probs: Column, label: Column) -> Column:
    return F.get(probs, label)


def squared_error(probs: str, label: str, k: int) -> Column:
    """Sum over classes of (p - one_hot)^2; both arguments are column names."""
    if k <= UNROLL:
        gaps = [f"(get({probs}, {i}) - CAST({label} = {i} AS DOUBLE))" for i in range(k)]
        return F.expr(plus(f"{gap} * {gap}" for gap in gaps))
    return F.expr(
        f"aggregate(transform({probs}, (p, i) -> power(p - CAST({label} = i AS DOUBLE), 2)), "
        "CAST(0 AS DOUBLE), (acc, x) -> acc + x)"
    )


def bin_edges(bins: int) -> list[float]:
    """Edges of equal bins on [0, 1] as multiples of the step, the last exactly 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def confidence_bin(value: str, bins: int) -> Column:
    """0-based bin by comparison with the edges; the last bin is closed on the right."""
    inner = bin_edges(bins)[1:-1]
    return F.expr(plus(f"CAST({value} >= {edge!r}D AS INT)" for edge in inner))
