"""Nested advice JSON to flat tables, through VARIANT because descriptions vary in type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwarden.functions.text import as_paragraphs


@dataclass(frozen=True)
class Knowledge:
    meta: DataFrame  # class_name, lang, name, description
    items: DataFrame  # class_name, lang, pos, text
    notes: DataFrame  # class_name, lang, season, text


def _entries(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row per entry of a VARIANT object, named ``key`` and ``value``."""
    kept = [c for c in df.columns if c != column]
    exploded = df.withColumnRenamed(column, "_object").lateralJoin(
        df.sparkSession.tvf.variant_explode(F.col("_object").outer())
    )
    return exploded.select(
        *kept, F.col("key").alias(key), F.col("value").alias("value")
    )


def parse_object(df: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON text; anything but an object fails the query."""
    parsed = F.parse_json(F.col(column))
    wrong = F.raise_error(F.lit("the knowledge file must hold a JSON object"))
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return df.withColumn(column, F.when(is_object, parsed).otherwise(wrong.cast("variant")))


def flatten_knowledge(per_class: DataFrame) -> Knowledge:
    """``per_class``: class_name, value VARIANT {lang: {name, description, general, season_notes}}."""
    per_lang = _entries(per_class.select("class_name", "value"), "value", "lang")
    meta = per_lang.select(
        "class_name",
        "lang",
        F.try_variant_get("value", "$.name", "string").alias("name"),
        as_paragraphs(F.try_variant_get("value", "$.description", "variant")).alias(
            "description"
        ),
    )
    items = per_lang.select(
        "class_name",
        "lang",
        F.posexplode(F.try_variant_get("value", "$.general", "array<string>")).alias(
            "pos", "text"
        ),
    )
    notes = per_lang.select(
        "class_name",
        "lang",
        F.explode(
            F.try_variant_get("value", "$.season_notes", "map<string,string>")
        ).alias("season", "text"),
    )
    return Knowledge(meta, items, notes)


def load_knowledge(spark: SparkSession, path: str) -> Knowledge:
    """One JSON object: class -> language -> content."""
    whole = parse_object(spark.read.text(path, wholetext=True))
    return flatten_knowledge(_entries(whole, "value", "class_name"))


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object: class -> list of {title, url}; gives class_name, pos, title, url."""
    whole = parse_object(spark.read.text(path, wholetext=True))
    listed = _entries(whole, "value", "class_name").select(
        "class_name",
        F.posexplode(
            F.try_variant_get("value", "$", "array<struct<title:string,url:string>>")
        ).alias("pos", "link"),
    )
    return listed.select("class_name", "pos", "link.title", "link.url")
