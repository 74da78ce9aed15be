"""Building blocks that keep the other operators safe on very large, skewed tables.

* ``materialise``      cuts lineage by writing a table to the cluster's shared folder.
* ``spread``           adds tasks only when a scan has fewer splits than the cluster has cores.
* ``bounded_broadcast`` broadcasts a side only after checking its size.
* ``attach``           joins rows to one-row-per-key facts with the hot keys salted.
* ``expand``           joins many to many with keys split by the pairs they give.
* ``number_rows``      dense numbers in a global order without a single-task window.
* ``prefix_sums``      running sums in a global order without a single-task window.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
# Rows that one task should get of one key; a key with more is hot and gets as many salts as
# it has such portions.
TARGET_ROWS = 1_000_000
# The list of hot keys is broadcast, so there may be at most this many: beyond, only keys with
# more than 1 / MAX_HOT of all rows count as hot.
MAX_HOT = 500_000

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits
_local_scratch: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary folder only in local mode."""
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="splitwarden-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/splitwarden/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and continue from the files, so lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in stored:
        path = getattr(table, "scratch_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that is too coarse to use the cluster (one huge file).

    Only for a plain scan: asking a plan with shuffles for its partitions would run it.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` is shown to be small in rows and bytes, else leave it."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(limit + 1).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    small = seen["n"] <= limit and (seen["bytes"] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if small else df


def _hot_keys(sizes: DataFrame, keys: Sequence[str], size: str) -> DataFrame | None:
    """(keys, _salts) of the keys whose ``size`` is more than a task should get; None if none."""
    seen = sizes.agg(F.sum(F.col(size).cast("double")).alias("total"), F.max(size).alias("top")).first()
    threshold = max(TARGET_ROWS, int((seen["total"] or 0) / MAX_HOT))
    if (seen["top"] or 0) <= threshold:
        return None
    return sizes.filter(F.col(size) > threshold).select(
        *keys, F.ceil(F.col(size) / TARGET_ROWS).cast("int").alias("_salts")
    )


def _salted(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``_salt``: of a hot key by a hash of the row, so a retried task deals alike."""
    spread_by = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("_salts"))
    joined = rows.join(F.broadcast(hot), list(keys), "left")
    return joined.withColumn("_salt", F.coalesce(spread_by, F.lit(0)).cast("int")).drop("_salts")


def _copied(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One copy of each row per salt of its key."""
    joined = rows.join(F.broadcast(hot), list(keys), "left")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return joined.withColumn("_salt", F.explode(salts)).drop("_salts")


def attach(
    rows: DataFrame,
    facts: DataFrame,
    key: str | Sequence[str],
    size: str,
    how: str = "inner",
    keep_size: bool = True,
) -> DataFrame:
    """Join ``rows`` to ``facts`` (``size`` = rows owned by the key), splitting hot keys.

    Hot keys are found from the sizes already in ``facts``; their rows get a salt and
    their facts one copy per salt, so no task receives a whole hot group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    facts = materialise(facts, "facts")
    hot = _hot_keys(facts, keys, size)
    if hot is None:
        joined = rows.join(facts, keys, how)
    else:
        salted = _salted(rows, hot, keys)
        joined = salted.join(_copied(facts, hot, keys), [*keys, "_salt"], how).drop("_salt")
    return joined if keep_size else joined.drop(size)


def expand(left: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Equi-join on ``key`` where one key may give very many pairs.

    A key is split by the number of pairs it gives, not by the rows of one side: its members
    are salted and its left rows copied, so every task makes about ``TARGET_ROWS`` pairs.
    """
    counts = members.groupBy(key).agg(F.count("*").alias("_members"))
    pairs = left.groupBy(key).agg(F.count("*").alias("_left")).join(counts, key)
    # Products of counts pass 64 bits on large keys.
    pairs = pairs.select(
        key, (F.col("_left").cast("double") * F.col("_members")).alias("_pairs"), "_members"
    )
    pairs = materialise(pairs.filter(F.col("_pairs") > TARGET_ROWS), "pairs")
    hot = _hot_keys(pairs, [key], "_pairs")
    if hot is None:
        release(pairs)
        return left.join(members, key)
    # More salts than members would only copy the left rows.
    hot = hot.join(pairs.select(key, "_members"), key).select(
        key, F.least("_salts", F.col("_members").cast("int")).alias("_salts")
    )
    hot = materialise(hot, "hot")
    return _copied(left, hot, [key]).join(_salted(members, hot, [key]), [key, "_salt"]).drop("_salt")


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    ranks: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Add 1-based dense positions in ``order``, one column per entry of ``ranks``.

    Each value of ``ranks`` is a leading run of plain columns of ``order`` within which
    counting restarts (empty = over the whole table). ``order`` must be a total order for
    the result to be deterministic. The table is range-partitioned and sorted once; the
    position of a row is its index inside its range plus the sizes of the ranges before,
    so only one number per range (at most the shuffle partition count) meets the driver.
    """
    spark = df.sparkSession
    columns = _columns(order)
    ordered = materialise(
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "ordered",
    )
    slot = F.shiftright("_pos", _INDEX_BITS)
    sizes = ordered.groupBy(slot.alias("_slot")).count().orderBy("_slot").collect()
    offsets, running = [], 0
    for row in sizes:
        offsets.append((row["_slot"], running))
        running += row["count"]
    offset_table = F.broadcast(
        spark.createDataFrame(offsets or [(0, 0)], "_slot bigint, _offset bigint")
    )

    def position(table: DataFrame, name: str) -> DataFrame:
        index = F.col("_pos").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
        return (
            table.withColumn("_slot", slot)
            .join(offset_table, "_slot")
            .withColumn(name, F.col("_offset") + index + 1)
            .drop("_slot", "_offset")
        )

    result = position(ordered, "_number")
    for name, group in ranks.items():
        if not group:
            result = result.withColumn(name, F.col("_number"))
            continue
        starts = ordered.groupBy(*group).agg(F.min("_pos").alias("_pos"), F.count("*").alias("_owned"))
        firsts = position(starts, "_first").drop("_pos")
        result = (
            attach(result, firsts, list(group), "_owned", keep_size=False)
            .withColumn(name, F.col("_number") - F.col("_first") + 1)
            .drop("_first")
        )
    return result.drop("_number", "_pos")


def prefix_sums(
    df: DataFrame,
    within: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running inclusive sums ``{output: input}`` per ``within`` group in ``order``.

    ``totals`` names output columns for the whole sum of a group, ``{output: input}``.

    Same two-pass scheme as ``number_rows``: sums inside each range by a window that sees
    one range only, plus the totals of the ranges before it.
    """
    columns = _columns([*within, *order])
    ordered = materialise(
        df.repartitionByRange(*columns).withColumn("_slot", F.spark_partition_id()),
        "ranges",
    )
    totals = totals or {}
    per_range = ordered.groupBy("_slot", *within).agg(
        *[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()],
        *[F.sum(src).alias(f"_g_{out}") for out, src in totals.items()],
    )
    group = Window.partitionBy(*within)
    before = (
        Window.partitionBy(*within)
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_range.select(
        "_slot",
        *within,
        *[
            F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}")
            for out in sums
        ],
        *[F.sum(f"_g_{out}").over(group).alias(out) for out in totals],
    )
    local = (
        Window.partitionBy("_slot", *within)
        .orderBy(*_columns(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = ordered.select(
        "*", *[F.sum(src).over(local).alias(f"_l_{out}") for out, src in sums.items()]
    )
    # Both sides are keyed like the window, so the join adds no shuffle of the rows.
    joined = running.join(offsets, ["_slot", *within])
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums],
        *totals,
    )
