"""Groups of rows with equal content.

Records carry ``row_no`` (position by class order, then path), ``class_index``,
``class_name``, ``relative_path``, ``sha256`` and, for near duplicates, ``dhash``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.functions import keys as K
from splitwarden.operators.scale import attach, number_rows


def number_records(records: DataFrame) -> DataFrame:
    """Add ``row_no``: the scan position, classes in dictionary order, then path order."""
    return number_rows(records, ["class_index", "relative_path"], {"row_no": []})


def content_groups(records: DataFrame) -> DataFrame:
    """One row per content shared by two or more records."""
    return (
        records.groupBy("sha256")
        .agg(
            F.count("*").alias("group_size"),
            F.min("relative_path").alias("first_path"),
            F.min("class_index").alias("_low"),
            F.max("class_index").alias("_high"),
        )
        .filter("group_size >= 2")
        .withColumn("cross_class_duplicate", F.col("_low") < F.col("_high"))
        .drop("_low", "_high")
    )


def exact_duplicates(records: DataFrame) -> DataFrame:
    """Member rows of every content group, groups numbered by their first path."""
    groups = number_rows(content_groups(records), ["first_path"], {"number": []})
    facts = groups.select(
        "sha256",
        K.exact_id(F.col("number")).alias("exact_group_id"),
        "group_size",
        "cross_class_duplicate",
    )
    return attach(records, facts, "sha256", "group_size").select(
        "exact_group_id",
        "sha256",
        "class_name",
        "relative_path",
        "path",
        "group_size",
        "cross_class_duplicate",
    )


def exact_summary(groups: DataFrame) -> DataFrame:
    """Counts of groups, files, redundant copies and groups across classes."""
    return groups.agg(
        F.count("*").alias("exact_duplicate_groups"),
        F.coalesce(F.sum("group_size"), F.lit(0)).alias("files_in_exact_duplicate_groups"),
        F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).alias("redundant_exact_copies"),
        F.count_if("cross_class_duplicate").alias("cross_class_exact_duplicate_groups"),
    )


def exact_edges(records: DataFrame) -> DataFrame:
    """Links (src > dst) from each record to the first record of its content group.

    Groups that span classes create no links. A star has one edge per copy, never one per
    pair, so a content held by a third of all rows costs a third of the rows.
    """
    stars = (
        records.groupBy("sha256")
        .agg(
            F.count("*").alias("group_size"),
            F.min("row_no").alias("dst"),
            F.min("class_index").alias("_low"),
            F.max("class_index").alias("_high"),
        )
        .filter("group_size >= 2 AND _low = _high")
        .select("sha256", "dst", "group_size")
    )
    rows = records.select("sha256", F.col("row_no").alias("src"))
    return attach(rows, stars, "sha256", "group_size").select("src", "dst")
