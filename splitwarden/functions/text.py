"""Tokenising, rule classification and keyword extraction as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.functions import keys as K
from splitwarden.functions.lexicon import BILINGUAL_RULES, LanguageRules
from splitwarden.functions.sqltext import plus, quoted, string_array, string_map

# Fixed value: runs of letters and digits joined by one hyphen, apostrophe or right quote.
# Possessive, because a run can never give letters back to the rest of the pattern.
TOKEN_PATTERN = r"[\p{L}\p{N}]++(?:[-’'][\p{L}\p{N}]++)*+"
KEYWORD_LIMIT = 6
MIN_KEYWORD_CHARS = 3
PHRASE_WEIGHT = 3


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Where full case folding differs from lower-casing: single and multi character cases."""
    single, multi = {}, {}
    for code in range(0x110000):
        char = chr(code)
        lower, folded = char.lower(), char.casefold()
        if lower == folded or char != lower:
            continue
        if len(folded) == 1:
            single[char] = folded
        else:
            multi[char] = folded
    return "".join(single), "".join(single.values()), multi


def _guard(chars: str, gap: int = 0x100) -> str:
    """Character class of a few ranges that covers ``chars``; cheap to test on every text."""
    codes = sorted(map(ord, set(chars) - {"ß"}))
    ranges = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code - ranges[-1][1] <= gap and ranges[-1][0] > 0x2FF:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


def casefold_sql(text: str) -> str:
    """Unicode case folding: lower-case, then the characters folding maps further."""
    source, target, multi = _folding()
    lowered = f"replace(lower({text}), 'ß', 'ss')"
    rare = f"translate(x, {quoted(source)}, {quoted(target)})"
    for char, folded in multi.items():
        if char != "ß":
            rare = f"replace({rare}, {quoted(char)}, {quoted(folded)})"
    needed = quoted(_guard(source + "".join(multi)))
    # The lambda evaluates the lower-cased text once; rare letters are folded on demand.
    folded = f"transform(array({lowered}), x -> CASE WHEN x RLIKE {needed} THEN {rare} ELSE x END)"
    return f"get({folded}, 0)"


def casefold(text: str) -> Column:
    return F.expr(casefold_sql(text))


def tokenize(text: str) -> Column:
    """Tokens of a text column, given by name."""
    return F.expr(f"regexp_extract_all({casefold_sql(text)}, {quoted(TOKEN_PATTERN)}, 0)")


def normalize_phrase(text: str) -> Column:
    return F.array_join(tokenize(text), " ")


def fold_literal(term: str) -> str:
    """``normalize_phrase`` for a Python literal, used for rule terms."""
    return " ".join(re.findall(r"[^\W_]+(?:[-’'][^\W_]+)*", term.casefold()))


def contains_sql(phrase: str, term: str) -> str:
    """Whether a normalised phrase holds the term as whole tokens.

    Tokens hold no spaces, so one padded substring test covers both single tokens and
    phrases. A term without any token never matches.
    """
    folded = fold_literal(term)
    if not folded:
        return "false"
    return f"contains(concat(' ', {phrase}, ' '), {quoted(f' {folded} ')})"


def contains_term(phrase: str, term: str) -> Column:
    return F.expr(contains_sql(phrase, term))


def _matched(phrase: str, terms: Sequence[str]) -> str:
    if not terms:
        return "CAST(array() AS ARRAY<STRING>)"
    cells = [f"CASE WHEN {contains_sql(phrase, t)} THEN {quoted(t)} END" for t in terms]
    return f"array_compact(array({', '.join(cells)}))"


def term_weight(term: str) -> int:
    return PHRASE_WEIGHT if " " in term else 1


def category_sql(phrase: str, rules: LanguageRules) -> str:
    """Struct of the winning category and its matched terms; ties go to the earlier priority."""
    scored = []
    for rank, category in enumerate(rules.priority):
        terms = rules.terms.get(category, ())
        score = plus(
            f"CAST({contains_sql(phrase, t)} AS INT) * {term_weight(t)}" for t in terms
        )
        scored.append(
            f"named_struct('score', {score}, 'rank', {-rank}, 'category', {quoted(category)}, "
            f"'matched_terms', {_matched(phrase, terms)})"
        )
    none = (
        f"named_struct('category', {quoted(rules.default)}, "
        "'matched_terms', CAST(array() AS ARRAY<STRING>))"
    )
    chosen = "named_struct('category', b.category, 'matched_terms', b.matched_terms)"
    best = f"array_max(array({', '.join(scored)}))"
    return (
        f"get(transform(array({best}), b -> CASE WHEN b.score > 0 THEN {chosen} ELSE {none} END), 0)"
    )


def category_struct(phrase: str, rules: LanguageRules) -> Column:
    return F.expr(category_sql(phrase, rules))


def keywords_sql(
    tokens: str, phrase: str, matched: str, rules: LanguageRules, limit: int = KEYWORD_LIMIT
) -> str:
    """Matched terms, then other rule terms in rule order, then content tokens; first ``limit``.

    Duplicates are dropped by normalised form: rule terms are literals whose normalised
    form is known, and a token is its own normalised form.
    """
    unique = list(dict.fromkeys(t for terms in rules.terms.values() for t in terms))
    content = (
        f"filter({tokens}, t -> length(t) >= {MIN_KEYWORD_CHARS} "
        f"AND NOT array_contains({string_array(sorted(rules.stopwords))}, t))"
    )
    candidates = f"concat({matched}, {_matched(phrase, unique)}, {content})"
    altered = {t: fold_literal(t) for t in unique if fold_literal(t) != t}
    if not altered:
        return f"slice(array_distinct({candidates}), 1, {limit})"
    folded = f"transform(cs, c -> coalesce(try_element_at({string_map(altered)}, c), c))"
    first = (
        f"transform(array({candidates}), cs -> transform(array({folded}), fs -> "
        "filter(cs, (c, i) -> array_position(fs, get(fs, i)) = i + 1)))"
    )
    return f"slice(get(get({first}, 0), 0), 1, {limit})"


def keywords(
    tokens: str, phrase: str, matched: str, rules: LanguageRules, limit: int = KEYWORD_LIMIT
) -> Column:
    return F.expr(keywords_sql(tokens, phrase, matched, rules, limit))


def _by_language(language: str, rules: Mapping[str, LanguageRules], branch) -> str:
    cases = " ".join(f"WHEN {language} = {quoted(n)} THEN {branch(r)}" for n, r in rules.items())
    error = f"raise_error(concat('unsupported language: ', coalesce({language}, 'NULL')))"
    return f"CASE {cases} ELSE {error} END"


def with_analysis(
    df: DataFrame,
    text: str,
    language: str,
    rules: Mapping[str, LanguageRules] = BILINGUAL_RULES,
    name: str = "analysis",
) -> DataFrame:
    """Add the analysis struct of a text column; an unsupported language fails the query.

    Tokens, phrase and category are columns of their own, so each is computed once.
    """
    steps = (
        df.withColumn("_tokens", tokenize(text))
        .withColumn("_phrase", F.array_join("_tokens", " "))
        .withColumn(
            "_best", F.expr(_by_language(language, rules, lambda r: category_sql("_phrase", r)))
        )
        .withColumn(
            "_label",
            F.expr(
                _by_language(
                    language, rules, lambda r: f"element_at({string_map(r.labels)}, _best.category)"
                )
            ),
        )
        .withColumn(
            "_keywords",
            F.expr(
                _by_language(
                    language,
                    rules,
                    lambda r: keywords_sql("_tokens", "_phrase", "_best.matched_terms", r),
                )
            ),
        )
    )
    struct = (
        f"named_struct('text', {text}, 'formatted_text', concat(_label, ': ', {text}), "
        "'category', _best.category, 'category_label', _label, 'keywords', _keywords, "
        "'matched_terms', _best.matched_terms, 'token_count', size(_tokens))"
    )
    return steps.withColumn(name, F.expr(struct)).drop(
        "_tokens", "_phrase", "_best", "_label", "_keywords"
    )


def escape_html(text: Column) -> Column:
    """Escape the five special characters, ampersand first."""
    # Fixed values.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def valid_link(title: Column, url: Column) -> Column:
    """Title and URL present, URL parses, scheme is http or https."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(
        (F.length(title) > 0) & (F.length(url) > 0) & scheme.isin("http", "https"),
        F.lit(False),
    )


def as_paragraphs(value: Column) -> Column:
    """A VARIANT holding text or a list of texts, as a list without blank entries."""
    listed = F.coalesce(
        F.try_variant_get(value, "$", "array<string>"),
        F.array(F.try_variant_get(value, "$", "string")),
    )
    return F.filter(listed, lambda p: p.isNotNull() & (K.strip(p) != ""))
