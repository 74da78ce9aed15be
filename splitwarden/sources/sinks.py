"""Table, split and prediction-record sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitwarden.functions import keys as K
from splitwarden.functions import probs as P
from splitwarden.operators.scale import materialise


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """CSV with header, JSON lines or Parquet; files are written by the tasks."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)


def split_destinations(df: DataFrame) -> DataFrame:
    """Add ``destination_relative_path``: split/class/flattened name, all of them different.

    The first row (by relative path) that claims a name gets it. The others claim
    <stem>_<n><suffix>, from the number of claims before them, and go on counting while the
    name is taken, by a row that was given it before or by one that claims it too. Rounds are
    as many as the longest chain of taken names.
    """
    inside = F.regexp_replace("relative_path", r"^[^/]+/", "")
    keys = ["split", "class_name"]
    # Paths are unique, so a name has at most one clash per way of writing its separators
    # and the window groups stay tiny.
    clash = Window.partitionBy(*keys, "_flat").orderBy("relative_path")
    claims = df.select(*keys, "relative_path", K.flat_name(inside).alias("_flat")).withColumn(
        "_n", F.row_number().over(clash) - 1
    )
    taken = materialise(
        claims.filter("_n = 0").select(*keys, "relative_path", F.col("_flat").alias("_name")), "names"
    )
    waiting = materialise(claims.filter("_n > 0").select(*keys, "relative_path", "_n"), "waiting")
    while not waiting.isEmpty():
        numbered = waiting.withColumn(
            "_name",
            F.concat(
                K.file_stem(F.col("relative_path")),
                F.lit("_"),
                F.col("_n").cast("string"),
                K.file_suffix(F.col("relative_path")),
            ),
        )
        free = numbered.join(taken.select(*keys, "_name"), [*keys, "_name"], "left_anti")
        given = free.groupBy(*keys, "_name").agg(F.min("relative_path").alias("relative_path"))
        given = given.select(*keys, "relative_path", "_name")
        taken = materialise(taken.union(given), "names")
        waiting = materialise(
            waiting.join(taken, [*keys, "relative_path"], "left_anti").withColumn("_n", F.col("_n") + 1),
            "waiting",
        )
    return df.join(taken, [*keys, "relative_path"]).select(
        *df.columns, F.concat_ws("/", "split", "class_name", "_name").alias("destination_relative_path")
    )


def materialize_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the rows partitioned by split and class, so readers prune by split.

    Rows are rebalanced first: a small class of a split is one file whatever the number of tasks,
    and a large one is cut at the session's advisory partition size, hot or not.
    """
    split_destinations(df).hint("rebalance", "split", "class_name").write.mode(mode).partitionBy("split", "class_name").parquet(path)


def write_labeled_files(df: DataFrame, root: str, label: str, name: str = "rows.parquet") -> None:
    """Write the rows of each label as one Parquet file in parts: ``label``=<value>/file=``name``/.

    Rows are rebalanced first, so a part has about the session's advisory partition size, however
    many rows one label has.
    """
    named = df.withColumn("file", F.lit(name))
    named.hint("rebalance", label).write.partitionBy(label, "file").parquet(root)


def prediction_records(df: DataFrame, class_names: Sequence[str]) -> DataFrame:
    """Record per prediction: class, both confidences, all probabilities as a map.

    Needs ``probs`` and the temperature columns ``temperature_used`` and
    ``calibration_applied`` when calibration is in use.
    """
    names = F.array(*[F.lit(n) for n in class_names])
    top = F.array_max("probs")
    given = set(df.columns)
    return df.select(
        *[c for c in df.columns if c not in ("probs", "temperature_used", "calibration_applied")],
        F.get(names, P.predicted_index(F.col("probs"))).alias("prediction"),
        top.alias("confidence"),
        P.confidence_percent(top).alias("confidence_percent"),
        P.display_confidence(top).alias("display_confidence"),
        P.display_percent(top).alias("display_confidence_percent"),
        (F.col("temperature_used") if "temperature_used" in given else F.lit(1.0)).alias(
            "temperature_used"
        ),
        (
            F.col("calibration_applied") if "calibration_applied" in given else F.lit(False)
        ).alias("calibration_applied"),
        F.map_from_arrays(names, F.col("probs")).alias("all_probabilities"),
    )


def prediction_table(df: DataFrame, class_names: Sequence[str], extras: Sequence[str] = ()) -> DataFrame:
    """The wide prediction table: one probability column per class, then the extra columns.

    Needs ``y_true`` and ``probs``; a truth outside the classes gives a NULL name.
    """
    names = F.array(*[F.lit(n) for n in class_names])
    predicted = P.predicted_index(F.col("probs"))
    return df.select(
        F.get(names, F.col("y_true")).alias("actual_class"),
        F.get(names, predicted).alias("predicted_class"),
        (F.col("y_true") == predicted).alias("correct"),
        F.array_max("probs").alias("confidence"),
        *[F.get("probs", i).alias(f"probability_{n}") for i, n in enumerate(class_names)],
        *extras,
    )


def append_prediction_records(df: DataFrame, class_names: Sequence[str], path: str) -> None:
    prediction_records(df, class_names).write.mode("append").json(path)


def write_binary_files(files: DataFrame, root: str) -> int:
    """Write (relative_path, content) as single files under ``root``; returns their number.

    Tasks write in parallel to any store Arrow can reach. A file is moved to its name when it is
    complete, and attempts give equal bytes, so a retried task leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        place = "file:///" + root[5:].lstrip("/") if root.startswith("file:") else root
        system, folder = fs.FileSystem.from_uri(place)
        for batch in batches:
            for name, content in zip(batch.column("relative_path").to_pylist(), batch.column("content")):
                path = f"{folder}/{name}"
                parent, _, leaf = path.rpartition("/")
                system.create_dir(parent, recursive=True)
                draft = f"{parent}/_draft-{attempt}-{leaf}"
                with system.open_output_stream(draft) as out:
                    out.write(content.as_py())
                if system.get_file_info(path).type != fs.FileType.NotFound:
                    system.delete_file(path)
                system.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = files.select("relative_path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint")
    return written.agg(F.sum("n").alias("n")).first()["n"] or 0
