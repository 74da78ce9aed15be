"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is an SQL-side condition that rejects a document. On a sample of the documents the
share each rule rejects and the seconds it takes are measured; the rules are then ordered by
rejections per second, and each document meets them in that order in one CASE expression,
which stops at the first rule that rejects. The order changes only the cost: a document is
kept when no rule rejects it.

Words are runs of characters other than blank and U+0009..U+000D. Lines end at ``\\n``.

Cases: a null or empty text has no words, so the least-words rule rejects it; equal rows give
equal rows; a null doc_id is passed on; the sample may be empty (then the given order stays);
other columns are neither read nor changed.
"""

from __future__ import annotations

import time
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.operators.scale import materialise, release

SAMPLE_ROWS = 2_000  # documents on which costs and rejections are measured
MIN_WORDS = 50
_SPACES = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, even where it is used in a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def n_words(text: Column, w: Column) -> Column:
    return F.size(w).cast("bigint")


def word_chars(text: Column, w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("bigint")


def n_symbols(text: Column, w: Column) -> Column:
    return F.regexp_count(text, F.lit(_SYMBOLS)).cast("bigint")


def n_dup_lines(text: Column, w: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    spoken = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(spoken, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def n_repeat_words(text: Column, w: Column) -> Column:
    """Words that stand in a 3-word window found at least twice in the text.

    Window hashes are sorted as plain numbers; only a text that has equal neighbours sorts its
    windows with their places, and then counts the words its repeated windows cover.
    """

    def windows(w: Column) -> Column:
        # Element by element, because reading an array by place is slow in a lambda.
        def paired(h: Column) -> Column:
            two = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
            three = F.zip_with(two, F.slice(h, 3, F.size(h)), lambda ab, c: F.xxhash64(ab, c))
            return F.slice(three, 1, F.size(h) - 2)

        hashed = let(F.transform(w, lambda x: F.xxhash64(x)), paired)
        return F.when(F.size(w) >= 3, hashed).otherwise(F.array().cast("array<bigint>"))

    def has_twins(h: Column) -> Column:
        return F.size(F.array_distinct(h)) < F.size(h)

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = let(
            placed,
            lambda p: F.filter(
                F.transform(
                    p,
                    lambda x, i: F.when(
                        (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]), x["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            ),
        )
        return let(
            F.sort_array(twins),
            lambda t: F.aggregate(
                F.transform(t, lambda x, i: F.least(F.coalesce(F.get(t, i + 1) - x, F.lit(3)), F.lit(3))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    return let(
        windows(w), lambda h: F.when(has_twins(h), covered(h)).otherwise(F.lit(0))
    ).cast("bigint")


def n_lines(text: Column, w: Column) -> Column:
    """Lines with a word."""
    spoken = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return F.size(spoken).cast("bigint")


MEASURES = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": n_lines,
}

# A rule gives the condition that rejects; ``m`` gives a measure by its name.
RULES = {
    "few_words": lambda m: m("n_words") < MIN_WORDS,
    "repeated_words": lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"),
    "short_words": lambda m: m("word_chars") < 2 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 25 * m("n_words"),
    "symbols": lambda m: 5 * m("n_symbols") > m("word_chars"),
    "repeated_lines": lambda m: 3 * m("n_dup_lines") > m("n_lines"),
}


def _text(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def _inline(text: Column):
    """Measures computed where they are named, so a rule pays only for its own."""
    return lambda name: let(words(text), lambda w: MEASURES[name](text, w))


def rule_order(docs: DataFrame, text: str = "text", rules=None, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) on a sample of about ``sample_rows``, best first.

    Rejections per second decide; equal values keep the order of the names. The sample is a
    share of all rows, so the scan reads each file but only the sample is stored.
    """
    rules = rules or RULES
    narrow = docs.select(_text(docs, text).alias("text"))
    total = docs.count()
    sample = materialise(narrow.sample(min(1.0, sample_rows / max(1, total)), seed=42), "sample")
    measure = _inline(F.col("text"))
    rejected = sample.agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.avg(rule(measure).cast("int")), F.lit(0.0)).alias(name) for name, rule in rules.items()],
    ).first()
    found = []
    for name, rule in rules.items():
        start = time.perf_counter()
        sample.agg(F.sum(rule(measure).cast("int"))).collect()
        found.append((name, float(rejected[name]), time.perf_counter() - start))
    release(sample)
    return sorted(found, key=lambda x: (-x[1] / max(x[2], 1e-6), x[0]))


def first_failure(order: list[str], measure, rules=None) -> Column:
    """Name of the first rule of ``order`` that rejects, else null; later rules are not run."""
    rules = rules or RULES
    chain = None
    for name in order:
        chain = (F if chain is None else chain).when(rules[name](measure), F.lit(name))
    return chain


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the five measures, the base verdict and the verdict of the cascade."""
    order = [name for name, _, _ in rule_order(docs, text)]
    cut = docs.select(
        docs[doc_id].alias("doc_id"), _text(docs, text).alias("text"), words(_text(docs, text)).alias("words")
    )
    measured = cut.select(
        "doc_id", *[measure(F.col("text"), F.col("words")).alias(name) for name, measure in MEASURES.items()]
    )
    base_failed = RULES["few_words"](F.col) | RULES["repeated_words"](F.col)
    failed = first_failure(order, F.col)
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & failed.isNull()).alias("kept"),
        failed.alias("failed_rule"),
    )


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = [name for name, _, _ in rule_order(docs, text)]
    body = _text(docs, text)
    failed = let(words(body), lambda w: first_failure(order, lambda m: MEASURES[m](body, w)))
    return docs.filter(failed.isNull())
