"""Advice texts: analysis of every item and the result bundle per prediction.

The knowledge tables are small references (one row per class, language and item); they
are grouped into one bundle row per class and season before predictions meet them, so
predictions are only looked up, never grouped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.functions import text as X
from splitwarden.functions.lexicon import BILINGUAL_RULES, LanguageRules
from splitwarden.operators.scale import bounded_broadcast

# Description of the text analysis attached to each bundle.
COMPONENT_TYPE = "deterministic_rule_based_nlp"
COMPONENT_OPERATIONS = (
    "tokenization",
    "keyword_extraction",
    "rule_based_category_classification",
    "controlled_text_formatting",
)
SEASONS = ("wet", "dry")


def analyze_texts(
    df: DataFrame,
    text: str = "text",
    language: str = "lang",
    rules: Mapping[str, LanguageRules] = BILINGUAL_RULES,
) -> DataFrame:
    """Add ``analysis`` to every non-empty text; blank-only texts stay."""
    return X.with_analysis(df.filter(F.length(text) > 0), text, language, rules)


def classify_text(
    df: DataFrame, rules: LanguageRules, text: str = "text"
) -> DataFrame:
    """Add ``category`` and ``matched_terms``."""
    phrase = df.withColumn("_phrase", X.normalize_phrase(text))
    best = X.category_struct("_phrase", rules)
    return phrase.withColumn("_best", best).select(
        *df.columns, F.col("_best.category"), F.col("_best.matched_terms")
    )


def component() -> "F.Column":
    return F.struct(
        F.lit(COMPONENT_TYPE).alias("type"),
        F.col("lang").alias("language"),
        F.array(*[F.lit(o) for o in COMPONENT_OPERATIONS]).alias("operations"),
        F.lit(True).alias("content_preserved"),
    )


def advice_bundles(
    meta: DataFrame,
    items: DataFrame,
    notes: DataFrame,
    sources: DataFrame,
    rules: Mapping[str, LanguageRules] = BILINGUAL_RULES,
) -> DataFrame:
    """One row per (class, season, language).

    ``meta``: class_name, lang, name, description ARRAY. ``items``: class_name, lang, pos,
    text. ``notes``: class_name, lang, season, text. ``sources``: class_name, pos, title,
    url.
    """
    analysed = (
        analyze_texts(items, "text", "lang", rules)
        .groupBy("class_name", "lang")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "analysis"))).alias("_items"))
        .withColumn("recommendation_analysis", F.transform("_items", lambda i: i["analysis"]))
        .drop("_items")
    )
    links = (
        sources.groupBy("class_name")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "title", "url"))).alias("_links"))
        .withColumn(
            "sources",
            F.transform(
                "_links", lambda s: F.struct(s["title"].alias("title"), s["url"].alias("url"))
            ),
        )
        .drop("_links")
    )
    noted = notes.select("class_name", "lang", "season", F.col("text").alias("season_note"))
    seasons = F.array(*[F.lit(s) for s in SEASONS])
    joined = (
        meta.withColumn("season", F.explode(seasons))
        .join(noted, ["class_name", "lang", "season"], "left")
        .join(analysed, ["class_name", "lang"], "left")
        .join(links, "class_name", "left")
    )
    fallback = F.replace(F.col("class_name"), F.lit("_"), F.lit(" "))
    return joined.withColumn(
        "recommendation_analysis",
        F.when(
            F.col("recommendation_analysis").isNull(),
            F.slice("recommendation_analysis", 1, 0),
        ).otherwise(F.col("recommendation_analysis")),
    ).select(
        "class_name",
        "season",
        "lang",
        F.coalesce("name", fallback).alias("name"),
        F.coalesce("description", F.array().cast("array<string>")).alias("description"),
        F.transform("recommendation_analysis", lambda a: a["text"]).alias(
            "general_recommendations"
        ),
        "recommendation_analysis",
        F.coalesce("season_note", F.lit("")).alias("season_note"),
        F.coalesce(
            "sources", F.array().cast("array<struct<title:string,url:string>>")
        ).alias("sources"),
        component().alias("nlp_component"),
    )


def result_bundle(preds: DataFrame, bundles: DataFrame, strict: bool = True) -> DataFrame:
    """Look up every prediction (``class_name``, ``season``): one row per language.

    With ``strict`` a class without advice fails the query; otherwise its row stays without
    advice and ``found`` is false.
    """
    side = bounded_broadcast(bundles.withColumn("_known", F.lit(True)))
    joined = preds.join(side, ["class_name", "season"], "left")
    if not strict:
        return joined.withColumn("found", F.coalesce("_known", F.lit(False))).drop("_known")
    unknown = F.concat(F.lit("no advice for class "), F.coalesce("class_name", F.lit("NULL")))
    checked = F.coalesce("_known", F.raise_error(unknown).cast("boolean"))
    return joined.filter(checked).drop("_known")


def flat_bundle(bundle: DataFrame) -> DataFrame:
    """Readable one-line form: item and source counts, categories and keywords joined."""
    return bundle.withColumns(
        {
            "item_count": F.size("recommendation_analysis"),
            "source_count": F.size("sources"),
            "categories": F.array_join(
                F.transform("recommendation_analysis", lambda a: a["category"]), ","
            ),
        }
    )
