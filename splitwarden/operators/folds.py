"""Group-aware stratified folds, assignments, integrity and coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwarden.operators.quotas import fold_quotas
from splitwarden.operators.scale import attach, bounded_broadcast, materialise
from splitwarden.operators.splits import SEED, group_sizes, ranked_groups, size_histogram

# Fixed value: default number of folds.
N_FOLDS = 5


def fold_preconditions(df: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """Violations: groups with several classes, classes with fewer than ``k`` groups."""
    pairs = df.groupBy("class_index", "group_id").agg(F.count("*").alias("_n"))

    def rule(name: str, key: str, broken: str) -> DataFrame:
        return (
            pairs.groupBy(F.col(key).cast("string").alias("subject"))
            .agg(F.count("*").alias("value"))
            .filter(broken)
            .select(F.lit(name).alias("rule"), "subject", "value")
        )

    mixed = rule("group_with_several_classes", "group_id", "value > 1")
    scarce = rule("class_with_too_few_groups", "class_index", f"value < {int(k)}")
    return mixed.unionByName(scarce)


def group_kfold(df: DataFrame, k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """Add the held-out ``fold`` (1..k); a group never splits and classes stay balanced.

    Per class, larger groups are dealt first, each to the fold with fewest rows. Only the
    number of groups per (class, size, fold) is decided on the driver; which group goes
    where follows its seeded rank.
    """
    spark = df.sparkSession
    groups = materialise(group_sizes(df), "groups")
    bands = []
    for class_index, histogram in sorted(size_histogram(groups).items()):
        for size, dealt in fold_quotas(histogram, k).items():
            upto = 0
            for position, count in enumerate(dealt):
                # Start each class at another fold so that leftovers spread.
                fold = (position + class_index) % k + 1
                if count:
                    bands.append((class_index, size, upto, upto + count, fold))
                upto += count
    band_table = spark.createDataFrame(
        bands, "class_index int, group_size bigint, low bigint, high bigint, fold int"
    )
    listed = band_table.groupBy("class_index", "group_size").agg(
        F.sort_array(F.collect_list(F.struct("low", "high", "fold"))).alias("bands")
    )
    hit = F.filter(
        "bands", lambda b: (b["low"] < F.col("rank")) & (F.col("rank") <= b["high"])
    )
    placed = (
        ranked_groups(groups, seed)
        .join(bounded_broadcast(listed), ["class_index", "group_size"])
        .select("group_id", "group_size", F.get(hit, 0)["fold"].alias("fold"))
    )
    return attach(df.drop("group_size", "fold"), placed, "group_id", "group_size", keep_size=False)


def fold_roles(folds: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """Every row once, with bit masks of the folds it trains in and is held out in.

    Bit f - 1 stands for fold f, so there may be up to 63 folds. All counts come from the masks;
    only a sink that wants one row per fold and row unfolds them (``fold_assignments``).
    """
    if not 1 <= k <= 63:
        raise ValueError("between 1 and 63 folds")
    held = F.expr("shiftleft(1L, cast(fold AS int) - 1)")
    return folds.withColumns({"held_in": held, "trains_in": F.lit((1 << k) - 1).bitwiseXOR(held)})


def fold_assignments(folds: DataFrame, k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """One row per (fold, row) with its role, seed and fold seed: the table for a sink."""
    held = F.col("fold")
    return (
        folds.withColumn("_f", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumns(
            {
                "role": F.when(F.col("_f") == held, "validation").otherwise("train"),
                "seed": F.lit(seed),
                "fold_seed": F.lit(seed) + F.col("_f"),
            }
        )
        .withColumn("fold", F.col("_f"))
        .drop("_f")
    )


def _per_fold(counted: DataFrame, k: int) -> DataFrame:
    """One row per fold of a small table of masks, with whether each role has the fold's bit."""
    bit = F.expr("shiftleft(1L, cast(fold AS int) - 1)")
    return counted.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumns(
        {
            "train": F.col("trains_in").bitwiseAND(bit) != 0,
            "validation": F.col("held_in").bitwiseAND(bit) != 0,
        }
    )


def fold_integrity(roles: DataFrame, k: int = N_FOLDS) -> DataFrame:
    """Rows and groups per role and groups in both roles, per fold.

    Rows are shuffled once, by group; a group's masks are the union of those of its rows, and
    different masks are few.
    """
    per_group = roles.groupBy("group_id").agg(F.bit_or("trains_in").alias("trains_in"), F.bit_or("held_in").alias("held_in"))
    masks = ["trains_in", "held_in"]
    groups = _per_fold(per_group.groupBy(*masks).agg(F.count("*").alias("n")), k)
    rows = _per_fold(roles.groupBy(*masks).agg(F.count("*").alias("n")), k)

    def total(condition: str, name: str):
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0)).alias(name)

    counted = rows.groupBy("fold").agg(
        total("train", "train_image_count"), total("validation", "validation_image_count")
    )
    grouped = groups.groupBy("fold").agg(
        total("train", "train_group_count"),
        total("validation", "validation_group_count"),
        total("train AND validation", "overlap_group_count"),
    )
    return counted.join(grouped, "fold")


def fold_class_counts(roles: DataFrame, k: int = N_FOLDS) -> DataFrame:
    counted = _per_fold(roles.groupBy("class_index", "trains_in", "held_in").agg(F.count("*").alias("n")), k)
    part = F.explode(F.array(*[F.when(F.col(r), F.lit(r)) for r in ("train", "validation")]))
    listed = counted.select("fold", part.alias("role"), "class_index", "n").filter("role IS NOT NULL")
    return listed.groupBy("fold", "role", "class_index").agg(F.sum("n").alias("n"))


def oof_coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Counts that must be zero: missing, extra and repeated ids; one row.

    Both sides are tagged and summed per id, so one shuffle with partial sums replaces two
    anti joins.
    """
    tagged = expected.select(F.col(key), F.lit(1).alias("e"), F.lit(0).alias("o")).unionAll(
        observed.select(F.col(key), F.lit(0).alias("e"), F.lit(1).alias("o"))
    )
    per_id = tagged.groupBy(key).agg(F.sum("e").alias("e"), F.sum("o").alias("o"))
    return per_id.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("observed_rows"),
        F.count_if(F.expr("e > 0 AND o = 0")).alias("missing"),
        F.count_if(F.expr("e = 0 AND o > 0")).alias("extra"),
        F.count_if(F.expr("o > 1")).alias("repeated"),
    )
