"""Train / validation / test split that keeps duplicate groups whole, and its checks.

Manifest rows carry ``class_name``, ``class_index``, ``group_id`` and a row id such as
``relative_path``; a group has one class.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwarden.operators.quotas import solve_quotas
from splitwarden.operators.scale import attach, bounded_broadcast, materialise, number_rows

# Default shares and seed.
TRAIN_RATIO, VALIDATION_RATIO, TEST_RATIO = 0.70, 0.10, 0.20
SEED = 42


def check_ratios(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("train, validation and test ratios must sum to 1")


def default_ratios() -> tuple[float, float, float]:
    return TRAIN_RATIO, VALIDATION_RATIO, TEST_RATIO


def split_targets(df: DataFrame, ratios: Sequence[float] | None = None) -> DataFrame:
    """Target rows per class; halves round to even and train takes the rest."""
    ratios = tuple(ratios or default_ratios())
    check_ratios(ratios)
    total = F.col("total_class_images")
    return (
        df.groupBy("class_index", "class_name")
        .agg(F.count("*").alias("total_class_images"))
        .withColumns(
            {
                "test": F.bround(total * F.lit(ratios[2])).cast("bigint"),
                "validation": F.bround(total * F.lit(ratios[1])).cast("bigint"),
            }
        )
        .withColumn("train", total - F.col("test") - F.col("validation"))
    )


def group_sizes(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("group_id").agg(
        F.min("class_index").alias("class_index"), F.count("*").alias("group_size")
    )


def shuffle_key(seed: Column | int, group: Column) -> Column:
    """Order of groups under a seed; both engines and all runs agree on it."""
    return F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, int) else seed, group))


def size_histogram(groups: DataFrame) -> dict[int, dict[int, int]]:
    """class_index -> {group size -> number of groups}; bounded by the distinct sizes."""
    rows = groups.groupBy("class_index", "group_size").count().collect()
    result: dict[int, dict[int, int]] = defaultdict(dict)
    for row in rows:
        result[row["class_index"]][row["group_size"]] = row["count"]
    return result


def ranked_groups(groups: DataFrame, seed: int) -> DataFrame:
    """Position of every group among those of its class and size, in seeded order."""
    per_class = F.lit(seed) + F.col("class_index")
    keyed = groups.withColumn("_order", shuffle_key(per_class.cast("string"), F.col("group_id")))
    return number_rows(
        keyed,
        ["class_index", "group_size", "_order", "group_id"],
        {"rank": ["class_index", "group_size"]},
    ).drop("_order")


_QUOTAS = (
    "class_index int, test bigint, validation bigint, error bigint, proven boolean, "
    "quotas array<struct<group_size:bigint,to_test:bigint,to_validation:bigint>>"
)


def _solve_classes(ratios: Sequence[float]):
    """One row per class: targets, error, proof and the groups of each size for both parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for class_index, sizes in zip(batch.column("class_index").to_pylist(), batch.column("sizes").to_pylist()):
                histogram = {s["group_size"]: s["count"] for s in sizes}
                total = sum(size * count for size, count in histogram.items())
                test, validation = round(total * ratios[2]), round(total * ratios[1])
                quota, proven = solve_quotas(histogram, test, validation)
                reached = [sum(size * q[i] for size, q in quota.items()) for i in (0, 1)]
                error = abs(reached[0] - test) + abs(reached[1] - validation)
                dealt = [{"group_size": s, "to_test": a, "to_validation": b} for s, (a, b) in quota.items()]
                rows.append((class_index, test, validation, error, proven, dealt))
            struct = pa.struct([("group_size", pa.int64()), ("to_test", pa.int64()), ("to_validation", pa.int64())])
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(struct)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            names = ["class_index", "test", "validation", "error", "proven", "quotas"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _solved(groups: DataFrame, ratios: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(quotas per class and size, plan per class). Classes are solved in tasks of their own.

    A class has at most about sqrt(2 * rows) different sizes, so its histogram fits one row.
    """
    sizes = groups.groupBy("class_index", "group_size").count()
    histograms = sizes.groupBy("class_index").agg(
        F.sort_array(F.collect_list(F.struct("group_size", "count"))).alias("sizes")
    )
    # Rebalancing by AQE must not put all classes into one task.
    spread_out = histograms.repartition(max(1, groups.sparkSession.sparkContext.defaultParallelism), "class_index")
    plan = materialise(spread_out.mapInArrow(_solve_classes(ratios), _QUOTAS), "quotas")
    quotas = plan.select("class_index", F.explode("quotas").alias("q")).select("class_index", "q.*")
    return quotas, plan.drop("quotas")


def split_plan(manifest: DataFrame, ratios: Sequence[float] | None = None) -> DataFrame:
    """Per class: targets, the sum of both errors, and whether no other deal comes closer."""
    ratios = tuple(ratios or default_ratios())
    check_ratios(ratios)
    base = manifest.drop("group_size") if "group_size" in manifest.columns else manifest
    return _solved(group_sizes(base), ratios)[1]


def group_split(
    manifest: DataFrame, ratios: Sequence[float] | None = None, seed: int = SEED
) -> DataFrame:
    """Add ``group_size`` and ``split``; every group lands in one part, as close to the targets as
    whole groups allow. ``split_plan`` tells the errors and whether they are proven."""
    ratios = tuple(ratios or default_ratios())
    check_ratios(ratios)
    base = manifest.drop("group_size") if "group_size" in manifest.columns else manifest
    groups = materialise(group_sizes(base), "groups")
    quota_table, _ = _solved(groups, ratios)
    placed = (
        ranked_groups(groups, seed)
        .join(bounded_broadcast(quota_table), ["class_index", "group_size"], "left")
        .select(
            "group_id",
            "group_size",
            F.when(F.col("rank") <= F.coalesce("to_test", F.lit(0)), "test")
            .when(
                F.col("rank")
                <= F.coalesce("to_test", F.lit(0)) + F.coalesce("to_validation", F.lit(0)),
                "validation",
            )
            .otherwise("train")
            .alias("split"),
        )
    )
    return attach(base, placed, "group_id", "group_size")


def split_summary(manifest: DataFrame, ratios: Sequence[float] | None = None) -> DataFrame:
    """Target, actual and difference per (class, split), with group counts."""
    targets = split_targets(manifest, ratios)
    per_group = manifest.groupBy("class_index", "split", "group_id").agg(
        F.count("*").alias("files")
    )
    actual = per_group.groupBy("class_index", "split").agg(
        F.sum("files").alias("actual"), F.count("*").alias("groups")
    )
    groups = actual.groupBy("class_index").agg(F.sum("groups").alias("total_class_groups"))
    wanted = targets.select(
        "class_index",
        "class_name",
        "total_class_images",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("split"), F.col(s).alias("target"))
                    for s in ("train", "validation", "test")
                ]
            )
        ).alias("t"),
    ).select("class_index", "class_name", "total_class_images", "t.*")
    return (
        wanted.join(actual, ["class_index", "split"], "left")
        .join(groups, "class_index")
        .select(
            "class_name",
            "split",
            F.col("target").alias("target_image_count"),
            F.coalesce("actual", F.lit(0)).alias("actual_image_count"),
            (F.coalesce("actual", F.lit(0)) - F.col("target")).alias("difference_from_target"),
            F.coalesce("groups", F.lit(0)).alias("group_count"),
            "total_class_images",
            "total_class_groups",
        )
    )


def leakage_report(manifest: DataFrame) -> DataFrame:
    """Groups in several splits, groups with several classes, contents in several splits.

    "Several" is min <> max, which partial aggregation reduces before the shuffle.
    """

    def crossing(key: str, value: str, kind: str) -> DataFrame:
        return (
            manifest.filter(F.coalesce(F.col(key), F.lit("")) != "")
            .groupBy(F.col(key).alias("key"))
            .agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
            .filter("_low <> _high")
            .select(F.lit(kind).alias("kind"), "key")
        )

    return (
        crossing("group_id", "split", "group_in_several_splits")
        .unionByName(crossing("group_id", "class_name", "group_with_several_classes"))
        .unionByName(crossing("sha256", "split", "content_in_several_splits"))
    )
