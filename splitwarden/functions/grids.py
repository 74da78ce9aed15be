"""Difference hash and sharpness of a row-major numeric grid held in an array column.

``grid`` and ``gray`` are column names (or SQL text of an array).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Quality thresholds on 0..255 gray levels.
MIN_BRIGHTNESS, MAX_BRIGHTNESS, MIN_SHARPNESS = 45.0, 225.0, 60.0
# Luma weights.
LUMA = (0.299, 0.587, 0.114)


def dhash(grid: str, rows: int, cols: int) -> Column:
    """Bit = right cell greater than left cell, row-major, most significant bit first.

    The grid has at most 64 neighbouring pairs, so the bits are unrolled.
    """
    pairs = [r * cols + c for r in range(rows) for c in range(cols - 1)]
    if len(pairs) > 64:
        raise ValueError("a difference hash holds at most 64 bits")
    top = len(pairs) - 1
    bits = [
        f"shiftleft(CAST(get({grid}, {at + 1}) > get({grid}, {at}) AS BIGINT), {top - i})"
        for i, at in enumerate(pairs)
    ]
    while len(bits) > 1:
        bits = [" | ".join(bits[i : i + 2]) for i in range(0, len(bits), 2)]
        bits = [f"({b})" for b in bits]
    return F.expr(bits[0])


def _taps(new: int, old: int) -> tuple[list[int], list[int], list[float]]:
    """Per new cell: the two old cells it lies between and the weight of the second (half-pixel centres)."""
    at = [max((i + 0.5) * old / new - 0.5, 0.0) for i in range(new)]
    low = [min(int(x), old - 1) for x in at]
    return low, [min(i + 1, old - 1) for i in low], [x - i for x, i in zip(at, low)]


def resize(grid: str, rows: int, cols: int, new_rows: int, new_cols: int) -> Column:
    """Bilinear resize without antialiasing, as one array expression.

    The weights of each axis are literals, so every new cell is a sum of four old ones.
    """

    def listed(values: list, index: str) -> str:
        return f"get(array({', '.join(f'{v!r}D' if isinstance(v, float) else str(v) for v in values)}), {index})"

    (top, bottom, dy), (left, right, dx) = _taps(new_rows, rows), _taps(new_cols, cols)
    r, c = f"CAST(i DIV {new_cols} AS INT)", f"CAST(i % {new_cols} AS INT)"
    x = listed(dx, c)

    def line(row: list[int]) -> str:
        at = lambda side: f"CAST(get({grid}, {listed(row, r)} * {cols} + {listed(side, c)}) AS DOUBLE)"
        return f"({at(left)} * (1 - {x}) + {at(right)} * {x})"

    y = listed(dy, r)
    return F.expr(f"transform(sequence(0, {new_rows * new_cols - 1}), i -> {line(top)} * (1 - {y}) + {line(bottom)} * {y})")


def luma(red: Column, green: Column, blue: Column) -> Column:
    return red * LUMA[0] + green * LUMA[1] + blue * LUMA[2]


def brightness(gray: str) -> Column:
    return F.expr(
        f"aggregate({gray}, CAST(0 AS DOUBLE), (acc, x) -> acc + CAST(x AS DOUBLE)) / size({gray})"
    )


def laplacian(gray: str, width: int, height: int) -> str:
    """SQL text of the array of 4-neighbour Laplacians of the interior cells."""
    inner = [y * width + x for y in range(1, height - 1) for x in range(1, width - 1)]
    at = lambda i: f"CAST(get({gray}, {i}) AS DOUBLE)"
    cells = [
        f"{at(i)} * 4 - {at(i - 1)} - {at(i + 1)} - {at(i - width)} - {at(i + width)}"
        for i in inner
    ]
    return f"array({', '.join(cells)})"


def sharpness(gray: str, width: int, height: int) -> Column:
    """Population variance of the Laplacian; 0 when there is no interior."""
    if width < 3 or height < 3:
        return F.lit(0.0)
    values = laplacian(gray, width, height)
    count = (width - 2) * (height - 2)
    zero = "named_struct('s', CAST(0 AS DOUBLE), 'q', CAST(0 AS DOUBLE))"
    step = "(a, x) -> named_struct('s', a.s + x, 'q', a.q + x * x)"
    done = f"a -> a.q / {count} - (a.s / {count}) * (a.s / {count})"
    return F.expr(f"aggregate({values}, {zero}, {step}, {done})")


def quality_warnings(bright: str, sharp: str) -> Column:
    """Warning codes in fixed order, empty when the picture is fine."""
    codes = [
        f"CASE WHEN {bright} < {MIN_BRIGHTNESS} THEN 'tooDark' END",
        f"CASE WHEN {bright} > {MAX_BRIGHTNESS} THEN 'tooBright' END",
        f"CASE WHEN {sharp} < {MIN_SHARPNESS} THEN 'tooBlurry' END",
    ]
    return F.expr(f"array_compact(array({', '.join(codes)}))")


