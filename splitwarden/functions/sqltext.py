"""Helpers for expressions written as SQL text.

Long unrolled expressions are given to Spark as one SQL string: the JVM parses them in one
call, where building them column by column costs a round trip per operator.
"""

from __future__ import annotations

from collections.abc import Iterable


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: Iterable[str]) -> str:
    items = ", ".join(quoted(v) for v in values)
    return f"array({items})" if items else "CAST(array() AS ARRAY<STRING>)"


def string_map(values: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in values.items()) + ")"


def plus(terms: Iterable[str]) -> str:
    """Balanced sum, so that many terms do not nest deeply."""
    terms = list(terms)
    if not terms:
        return "0"
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return f"({plus(terms[:half])} + {plus(terms[half:])})"
