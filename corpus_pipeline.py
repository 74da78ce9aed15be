"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages before the last
return the columns of documents. ``run`` writes every stage to the shared folder and reads it
again, so a lost executor never repeats an earlier stage.

Cases: a null or empty text fails the quality rules (too few words), so it ends there; a null doc_id
passes all stages like any other; of rows that are repeated, near dedup keeps one; columns beside doc_id and
text pass the first four stages unchanged whatever their names, and packing leaves them; an empty
table goes through all stages and gives no rows; very long texts are read whole in every stage;
ties (equal lines, equal texts) go to the least doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitwarden.llm.decontaminate import drop_contaminated
from splitwarden.llm.lines import drop_repeated_lines
from splitwarden.llm.near_duplicates import drop_near_duplicates
from splitwarden.llm.packing import pack_documents
from splitwarden.llm.quality import quality_filter
from splitwarden.operators.scale import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, up to two edits, are taken out."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a telling share of benchmark words."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Near-duplicate classes and the packing search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
