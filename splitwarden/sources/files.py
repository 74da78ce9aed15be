"""Labelled file scans, media probing and the inventory table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwarden.functions import keys as K
from splitwarden.operators.scale import bounded_broadcast

# Accepted image suffixes.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")

INVENTORY_COLUMNS = [
    "class_name",
    "relative_path",
    "path",
    "readable",
    "error",
    "sha256",
    "dhash_hex",
    "width",
    "height",
    "mode",
]


def missing_classes(files: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes of the dictionary without a single accepted file."""
    return classes.join(files.select("class_name").distinct(), "class_name", "left_anti")


def class_folders(spark: SparkSession, root: str, classes: DataFrame, strict: bool = True) -> list[str]:
    """The folders of the class dictionary that exist."""
    names = [r["class_name"] for r in classes.select("class_name").collect()]  # the dictionary
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [n for n in names if system.exists(path(f"{root.rstrip('/')}/{n}"))]
    if strict and len(there) < len(names):
        raise ValueError(f"missing class folders: {', '.join(sorted(set(names) - set(there)))}")
    return [f"{root.rstrip('/')}/{n}" for n in there]


def scan_labeled_files(
    spark: SparkSession,
    root: str,
    classes: DataFrame,
    extensions: Sequence[str] = IMAGE_EXTENSIONS,
    strict: bool = True,
) -> DataFrame:
    """Files below ``root``/<class>/ with an accepted suffix (any letter case).

    Columns: class_name, relative_path, path, length, content. The content is read only
    when a later step selects it. Only the folders of the classes are listed, whatever else stands
    beside them. With ``strict`` a class without a folder or without a file is an error.
    """
    folders = class_folders(spark, root, classes, strict)
    empty = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
        if folders
        else spark.createDataFrame([], empty)
    )
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # Paths are listed in full, and local ones with one slash or three, however the root is written.
    base = re.sub("^file:/+", "/", system.makeQualified(folder).toString()).rstrip("/") + "/"
    listed = F.regexp_replace("path", "^file:/+", "/")
    accepted = (
        files.filter(F.startswith(listed, F.lit(base)))
        .withColumn("relative_path", F.substr(listed, F.lit(len(base) + 1)))
        .withColumn("class_name", F.regexp_extract("relative_path", r"^([^/]+)/", 1))
        .filter(K.file_suffix(F.col("relative_path")).isin(*extensions))
        .join(bounded_broadcast(classes.select("class_name")), "class_name", "left_semi")
        .select("class_name", "relative_path", "path", "length", "content")
    )
    if strict:
        absent = [r["class_name"] for r in missing_classes(accepted, classes).collect()]
        if absent:
            raise ValueError(f"classes without supported files: {', '.join(sorted(absent))}")
    return accepted


def file_of_part(relative_path: Column, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> Column:
    """The file a listed path belongs to, below its class folder.

    A folder with an accepted suffix is one file in parts, as Spark writes one; any other path is
    a file of its own.
    """
    suffixes = "|".join(re.escape(e) for e in extensions)
    return F.regexp_extract(relative_path, rf"(?is)^([^/]+/(?:[^/]+/)*?[^/]+(?:{suffixes}))(?:/|$)", 1)


# Colour mode by number of channels of the image source.
CHANNEL_MODES = {1: "L", 3: "RGB", 4: "RGBA"}


def probe_images(spark: SparkSession, root: str | Sequence[str], files: DataFrame) -> DataFrame:
    """Size, mode and digest of each file; undecodable files become rows with an error.

    ``root`` is the folder of the files, or a list of folders such as ``class_folders`` gives.
    """
    decoded = (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("recursiveFileLookup", True)
        .load(root if isinstance(root, str) else list(root))
        .select(
            F.col("image.origin").alias("origin"),
            "image.width",
            "image.height",
            "image.nChannels",
        )
    )
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    modes = F.create_map(*[F.lit(x) for kv in CHANNEL_MODES.items() for x in kv])
    hashed = files.select(
        "class_name",
        "relative_path",
        "path",
        F.sha2("content", 256).alias("sha256"),
        bare(F.col("path")).alias("_key"),
    )
    joined = hashed.join(
        decoded.withColumn("_key", bare(F.col("origin"))).drop("origin"), "_key", "left"
    )
    ok = F.coalesce(F.col("width") > 0, F.lit(False))
    return joined.select(
        "class_name",
        "relative_path",
        "path",
        ok.alias("readable"),
        F.when(~ok, F.lit("cannot identify image file")).alias("error"),
        F.when(ok, F.col("sha256")).alias("sha256"),
        F.when(ok, F.col("width")).alias("width"),
        F.when(ok, F.col("height")).alias("height"),
        F.when(ok, F.try_element_at(modes, F.col("nChannels"))).alias("mode"),
    )


def build_inventory(probed: DataFrame) -> DataFrame:
    """Inventory of readable and unreadable rows; value columns are NULL when unreadable."""
    ok = F.col("readable")
    columns = probed.columns

    def kept(name: str, kind: str):
        value = F.col(name) if name in columns else F.lit(None)
        return F.when(ok, value.cast(kind)).alias(name)

    if "dhash" in columns:
        hex_column = F.when(ok, K.hash_hex(F.col("dhash"))).alias("dhash_hex")
    else:
        hex_column = kept("dhash_hex", "string")
    error = F.col("error") if "error" in columns else F.lit(None).cast("string")
    return probed.select(
        "class_name",
        "relative_path",
        "path",
        "readable",
        F.when(~ok, F.coalesce(error, F.lit(""))).otherwise("").alias("error"),
        kept("sha256", "string"),
        hex_column,
        kept("width", "int"),
        kept("height", "int"),
        kept("mode", "string"),
    )
