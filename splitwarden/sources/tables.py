"""Readers for review tables, manifests, predictions, runs, dictionaries and parameters.

Contract checks come back as violation rows, so a table of any size is checked by the
same scan that reads it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwarden.functions import keys as K
from splitwarden.operators.scale import bounded_broadcast

BOM = "﻿"


def class_dictionary(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(class_index, class_name) in list order; names must be non-empty strings."""
    if not names or not all(isinstance(n, str) and n for n in names):
        raise ValueError("class names must be a non-empty list of non-empty strings")
    return spark.createDataFrame(list(enumerate(names)), "class_index int, class_name string")


def load_class_names(spark: SparkSession, path: str) -> DataFrame:
    """Class dictionary stored as one JSON list."""
    row = (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", "array<string>").alias("names"))
        .first()
    )
    return class_dictionary(spark, (row["names"] if row else None) or [])


def class_violations(dictionary: DataFrame) -> DataFrame:
    """Blank or repeated names of a dictionary table."""
    blank = dictionary.filter(F.coalesce(K.strip("class_name"), F.lit("")) == "").select(
        F.lit("blank_name").alias("rule"), F.col("class_index").cast("string").alias("subject")
    )
    repeated = (
        dictionary.groupBy("class_name").count().filter("count > 1")
        .select(F.lit("repeated_name").alias("rule"), F.col("class_name").alias("subject"))
    )
    return blank.unionByName(repeated)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def strip_bom(df: DataFrame) -> DataFrame:
    """Drop a byte order mark from the first column name."""
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def read_review_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Review files as text columns with their order: file, block of the file, row of the block.

    The order does not depend on how files are dealt to tasks or how large their splits are, so the
    last row of a pair is the same in every run. ``multi_line`` allows line ends inside quoted
    fields; a file is then read by one task, without it large files are split.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=multi_line, quote='"', escape='"')
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = raw.select(*[F.col(f"`{c}`") for c in raw.columns], place.alias("line_no"))
    return strip_bom(placed)


def read_review(df: DataFrame, order: str = "line_no", strict: bool = True) -> DataFrame:
    """Trimmed pairs with normalised decisions; the last row of a pair wins."""
    first = K.strip(F.coalesce("relative_path_1", F.lit("")))
    second = K.strip(F.coalesce("relative_path_2", F.lit("")))
    # Found by its first character that is none of white space, before the strings are cut.
    named = [F.col(c).rlike(r"(?U)[^\s\x1C-\x1F]") for c in ("relative_path_1", "relative_path_2")]
    cleaned = df.filter(named[0] & named[1]).select(
        first.alias("relative_path_1"),
        second.alias("relative_path_2"),
        K.normalise_decision(F.col("decision"), strict).alias("decision"),
        K.strip(F.coalesce("notes", F.lit(""))).alias("notes"),
        order,
    )
    key = K.pair_key(F.col("relative_path_1"), F.col("relative_path_2"))
    last = cleaned.groupBy(key.alias("_key")).agg(
        F.max_by(F.struct("decision", "notes"), F.col(order)).alias("last")
    )
    return last.select(
        F.col("_key.low").alias("relative_path_1"),
        F.col("_key.high").alias("relative_path_2"),
        "last.decision",
        "last.notes",
    )


MANIFEST_REQUIRED = ("split", "class_name", "class_index", "group_id", "relative_path")


def stripped_manifest(df: DataFrame) -> DataFrame:
    """The manifest as both the reader and the checks see it: text columns without white space
    around them."""
    require_columns(df, MANIFEST_REQUIRED)
    text = ("split", "class_name", "group_id", "relative_path")
    return df.withColumns({c: K.strip(F.col(c).cast("string")) for c in text})


def read_manifest(df: DataFrame, split: str, classes: DataFrame) -> DataFrame:
    """Rows of one split; a row of an unknown class fails the query instead of vanishing."""
    known = bounded_broadcast(classes.select("class_name", F.lit(True).alias("_known")))
    rows = (
        stripped_manifest(df)
        .filter(F.col("split") == split)
        .withColumn("class_index", F.col("class_index").cast("int"))
        .join(known, "class_name", "left")
    )
    unknown = F.concat(F.lit("unknown class in manifest: "), F.coalesce("class_name", F.lit("NULL")))
    return rows.filter(F.coalesce("_known", F.raise_error(unknown).cast("boolean"))).drop("_known")


def manifest_violations(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Every broken contract as (rule, subject)."""
    df = stripped_manifest(df)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checked = df.join(
        bounded_broadcast(classes.select("class_name", F.col("class_index").alias("_right"))),
        "class_name",
        "left",
    )
    rows = checked.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        blank("group_id") | blank("class_name") | blank("relative_path"),
                        F.lit("incomplete_row"),
                    ),
                    F.when(~blank("class_name") & F.col("_right").isNull(), F.lit("unknown_class")),
                    F.when(
                        F.col("class_index").cast("int") != F.col("_right"), F.lit("wrong_index")
                    ),
                )
            )
        ).alias("rule"),
        F.coalesce(F.col("relative_path").cast("string"), F.lit("")).alias("subject"),
    )
    repeated = (
        df.groupBy("relative_path").count().filter("count > 1")
        .select(F.lit("repeated_path").alias("rule"), F.col("relative_path").alias("subject"))
    )
    mixed = (
        df.groupBy("group_id")
        .agg(F.min("class_name").alias("_a"), F.max("class_name").alias("_b"))
        .filter("_a <> _b")
        .select(
            F.lit("group_with_several_classes").alias("rule"),
            F.col("group_id").cast("string").alias("subject"),
        )
    )
    empty = classes.join(df.select("class_name").distinct(), "class_name", "left_anti").select(
        F.lit("class_without_rows").alias("rule"), F.col("class_name").alias("subject")
    )
    return reduce(DataFrame.unionByName, [rows, repeated, mixed, empty])


def read_predictions(df: DataFrame, classes: DataFrame, label: str = "actual_class") -> DataFrame:
    """Class names to indices and the probability columns to one vector."""
    names = [r["class_name"] for r in classes.orderBy("class_index").collect()]
    columns = [f"probability_{n}" for n in names]
    require_columns(df, [label, *columns])
    index = bounded_broadcast(
        classes.select(F.col("class_name").alias(label), F.col("class_index").alias("y_true"))
    )
    rest = [c for c in df.columns if c not in columns]
    vector = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return df.join(index, label, "left").select(*rest, "y_true", vector.alias("probs"))


def discover_runs(spark: SparkSession, root: str, required: Sequence[str]) -> DataFrame:
    """(run, missing, complete) of every folder ``run=<name>/file=<table>/`` under ``root``.

    A table counts when it has a file with content; a run with a missing or empty one is not
    complete. Only names and lengths are listed, no content is read.
    """
    listed = spark.read.format("binaryFile").load(root).select(
        F.col("run").cast("string").alias("run"), F.col("file").cast("string").alias("file"), "length"
    )
    there = F.collect_set(F.when(F.col("length") > 0, F.col("file")))
    wanted = F.array(*[F.lit(name) for name in required])
    found = listed.groupBy("run").agg(F.array_sort(F.array_except(wanted, there)).alias("missing"))
    return found.withColumn("complete", F.size("missing") == 0)


def read_run_table(
    spark: SparkSession,
    root: str,
    name: str,
    schema: str,
    required: Sequence[str],
    requested: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """Rows of one table of all complete runs, with their ``run``.

    ``requested`` (column run) limits the runs. Strict reading fails, when it is executed, on a run
    that is not complete or not there; lenient reading leaves such runs out. Nothing is collected.
    """
    runs = discover_runs(spark, root, required)
    if requested is not None:
        runs = requested.select("run").distinct().join(runs, "run", "left").select(
            "run",
            F.coalesce("missing", F.array(*[F.lit(n) for n in required])).alias("missing"),
            F.coalesce("complete", F.lit(False)).alias("complete"),
        )
    table = spark.read.schema(f"{schema}, run string, file string").csv(root, header=True)
    rows = table.filter(F.col("file") == name).drop("file")
    kept = rows.join(runs.filter("complete"), "run", "left_semi").select(rows.columns)
    if not strict:
        return kept
    # A row for each incomplete run, which fails when it is made.
    text = F.concat(F.lit("incomplete run "), "run", F.lit(": "), F.array_join("missing", ", "))
    failing = runs.filter(~F.col("complete")).select(
        *[F.raise_error(text).cast(f.dataType).alias(f.name) for f in kept.schema.fields]
    )
    return kept.unionByName(failing)


def read_runs(table: DataFrame, runs: Sequence[str], strict: bool = True) -> DataFrame:
    """Rows of the requested runs of a table partitioned by ``run``.

    Strict reading fails on a run without rows; lenient reading skips it.
    """
    wanted = table.filter(F.col("run").isin(*runs))
    if strict:
        have = {r["run"] for r in wanted.select("run").distinct().collect()}
        missing = sorted(set(runs) - have)
        if missing:
            raise FileNotFoundError(f"no results for runs: {', '.join(missing)}")
    return wanted


def missing_runs(table: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested runs that have no row."""
    return requested.join(table.select("run").distinct(), "run", "left_anti")


def read_temperature(spark: SparkSession, path: str) -> tuple[float, bool]:
    """Stored temperature; an absent file means 1.0 and not applied."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return 1.0, False
    row = spark.read.json(path, schema="temperature double", multiLine=True).first()
    if row is None or row["temperature"] is None:
        raise ValueError("the temperature file is invalid")
    if row["temperature"] <= 0:
        raise ValueError("temperature must be greater than zero")
    return row["temperature"], True
