"""Group manifest, audit summary and the gate that blocks a split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.functions import keys as K
from splitwarden.operators.components import duplicate_components
from splitwarden.operators.scale import attach, materialise, number_rows

MANIFEST_COLUMNS = [
    "group_id",
    "class_name",
    "relative_path",
    "source_path",
    "sha256",
    "dhash_hex",
    "width",
    "height",
    "mode",
    "group_size",
    "grouping_basis",
]


def group_manifest(records: DataFrame, exact: DataFrame, near: DataFrame) -> DataFrame:
    """Number the duplicate groups of each class and say what holds each together.

    ``exact`` and ``near`` are link tables (``src``, ``dst``). Groups are numbered by
    their first path, which is their least ``row_no`` because a group has one class.
    """
    exact = materialise(exact, "exact-links")
    near = materialise(near, "near-links")

    def ends(links: DataFrame, flag: str) -> DataFrame:
        return links.select(F.explode(F.array("src", "dst")).alias("row_no")).select(
            "row_no",
            F.lit(flag == "by_exact").alias("by_exact"),
            F.lit(flag == "by_near").alias("by_near"),
        )

    touched = (
        ends(exact, "by_exact")
        .union(ends(near, "by_near"))
        .groupBy("row_no")
        .agg(F.max("by_exact").alias("by_exact"), F.max("by_near").alias("by_near"))
    )
    members = materialise(
        duplicate_components(
            records.select("row_no", "class_index"),
            exact.select("src", "dst").union(near.select("src", "dst")),
        ).join(touched, "row_no", "left"),
        "members",
    )
    groups = members.groupBy("component").agg(
        F.min("class_index").alias("class_index"),
        F.max("class_index").alias("_high"),
        F.count("*").alias("group_size"),
        F.coalesce(F.max("by_exact"), F.lit(False)).alias("by_exact"),
        F.coalesce(F.max("by_near"), F.lit(False)).alias("by_near"),
    )
    mixed = F.raise_error(F.lit("a duplicate group contains several classes"))
    groups = groups.withColumn(
        "class_index",
        F.when(F.col("class_index") == F.col("_high"), F.col("class_index")).otherwise(
            mixed.cast("int")
        ),
    ).drop("_high")
    numbered = number_rows(groups, ["class_index", "component"], {"number": ["class_index"]})
    # Names of the grouping bases.
    basis = (
        F.when(F.col("group_size") == 1, "singleton")
        .when(F.col("by_exact") & F.col("by_near"), "exact_and_confirmed_near")
        .when(F.col("by_exact"), "exact")
        .when(F.col("by_near"), "confirmed_near")
        .otherwise("linked_group")
    )
    facts = numbered.select("component", "number", "group_size", basis.alias("grouping_basis"))
    placed = attach(members.select("row_no", "component"), facts, "component", "group_size")
    return records.join(placed, "row_no").select(
        K.group_id(F.col("class_name"), F.col("number")).alias("group_id"),
        "class_index",
        "class_name",
        "relative_path",
        F.col("path").alias("source_path"),
        "sha256",
        K.hash_hex(F.col("dhash")).alias("dhash_hex"),
        "width",
        "height",
        "mode",
        "group_size",
        "grouping_basis",
    )


def class_counts(df: DataFrame, classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class of the dictionary, zero for absent classes; per key when ``by`` is set."""
    by = list(by)
    counted = df.groupBy(*by, "class_name").agg(F.count("*").alias("n"))
    if by:
        names = classes.agg(F.collect_list("class_name").alias("names"))  # the dictionary
        listed = F.array(*[F.lit(n) for n in names.first()["names"]])
        wanted = counted.select(*by).distinct().withColumn("class_name", F.explode(listed))
    else:
        wanted = classes.select("class_name")
    return wanted.join(counted, [*by, "class_name"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def group_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Files and distinct groups per key, counting groups in two steps."""
    per_group = df.groupBy(*by, "group_id").agg(F.count("*").alias("files"))
    return per_group.groupBy(*by).agg(
        F.sum("files").alias("image_count"), F.count("*").alias("group_count")
    )


def decision_counts(pairs: DataFrame) -> DataFrame:
    """Counters of record pairs over the reviewed list, one row.

    A row of the list counts for its ``n_pairs`` record pairs, or for one if it names no number.
    """
    decision = K.normalise_decision(F.col("decision"))
    cross = F.col("cross_class_candidate")
    stands_for = F.col("n_pairs") if "n_pairs" in pairs.columns else F.lit(1)

    def total(condition: Column, name: str) -> Column:
        counted = F.sum(F.when(condition, stands_for))
        return F.coalesce(counted, F.lit(0)).cast("decimal(38,0)").alias(name)

    return pairs.agg(
        total(F.lit(True), "potential_near_duplicate_pairs"),
        total(decision == "yes", "confirmed_near_duplicate_pairs"),
        total(decision == "no", "rejected_near_duplicate_pairs"),
        total(decision == "", "unresolved_near_duplicate_pairs"),
        total(cross, "cross_class_near_duplicate_candidates"),
        total((decision == "yes") & cross, "confirmed_cross_class_near_pairs"),
    )


def auto_decision_counts(totals: DataFrame) -> DataFrame:
    """The same counters for unreviewed automatic grouping, from ``near_pair_totals``."""
    pairs, cross = F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(
        F.sum("cross_class_pairs"), F.lit(0)
    )
    zero = F.lit(0).cast("bigint")
    return totals.agg(
        pairs.alias("potential_near_duplicate_pairs"),
        (pairs - cross).alias("confirmed_near_duplicate_pairs"),
        zero.alias("rejected_near_duplicate_pairs"),
        cross.alias("unresolved_near_duplicate_pairs"),
        cross.alias("cross_class_near_duplicate_candidates"),
        zero.alias("confirmed_cross_class_near_pairs"),
    )


def file_counts(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count("*").alias("supported_image_files_found"),
        F.count_if("readable").alias("readable_image_files"),
        F.count_if(~F.col("readable")).alias("unreadable_image_files"),
    )


def manifest_counts(manifest: DataFrame) -> DataFrame:
    sizes = manifest.groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.agg(
        F.count("*").alias("final_duplicate_groups"),
        F.count_if(F.col("size") > 1).alias("non_singleton_groups"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest_group_size"),
    )


def per_class_counts(manifest: DataFrame, classes: DataFrame) -> DataFrame:
    counted = group_counts(manifest, ["class_name"])
    joined = classes.select("class_name").join(counted, "class_name", "left")
    return joined.select(
        F.explode(
            F.array(
                F.struct(
                    F.concat(F.lit("class_file_counts."), "class_name").alias("counter"),
                    F.coalesce("image_count", F.lit(0)).cast("decimal(38,0)").alias("value"),
                ),
                F.struct(
                    F.concat(F.lit("class_group_counts."), "class_name").alias("counter"),
                    F.coalesce("group_count", F.lit(0)).cast("decimal(38,0)").alias("value"),
                ),
            )
        ).alias("c")
    ).select("c.*")


def audit_summary(
    inventory: DataFrame,
    exact: DataFrame,
    decisions: DataFrame,
    manifest: DataFrame,
    classes: DataFrame,
) -> DataFrame:
    """All audit counters as (counter, value); counts of pairs may pass 64 bits.

    ``exact`` is the one-row result of ``exact_summary`` and ``decisions`` that of
    ``decision_counts`` or ``auto_decision_counts``.
    """

    def upright(row: DataFrame) -> DataFrame:
        wide = row.select(*[F.col(c).cast("decimal(38,0)").alias(c) for c in row.columns])
        return wide.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("counter"), F.col(c).alias("value"))
                        for c in row.columns
                    ]
                )
            ).alias("c")
        ).select("c.*")

    one_row = [file_counts(inventory), exact, decisions, manifest_counts(manifest)]
    parts = [upright(row) for row in one_row] + [per_class_counts(manifest, classes)]
    return reduce(DataFrame.unionByName, parts)


# Counters that block a split and the reason given.
BLOCKERS = {
    "unreadable_image_files": "unreadable files",
    "cross_class_exact_duplicate_groups": "equal content under different classes",
    "confirmed_cross_class_near_pairs": "confirmed near pair under different classes",
    "unresolved_near_duplicate_pairs": "near pairs without a decision",
}


def audit_gate(summary: DataFrame, allow_unreviewed: bool = False) -> DataFrame:
    """Blocking reasons with their counts; an empty result means the split may run."""
    waived = {"unresolved_near_duplicate_pairs"} if allow_unreviewed else set()
    active = {k: v for k, v in BLOCKERS.items() if k not in waived}
    reasons = F.create_map(*[F.lit(x) for kv in active.items() for x in kv])
    return summary.filter(F.col("counter").isin(*active) & (F.col("value") > 0)).select(
        "counter", "value", reasons[F.col("counter")].alias("reason")
    )
