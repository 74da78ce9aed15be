"""Prediction requests as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from splitwarden.functions import dates as D
from splitwarden.operators.advice import result_bundle
from splitwarden.operators.images import admit_images
from splitwarden.operators.scale import scratch_path


def enrich_requests(requests: DataFrame, bundles: DataFrame) -> DataFrame:
    """Admit each request, derive its season and look up its bundle.

    Works on batch and streaming input alike: no step keeps state, and the bundles are a
    static side. Rejected requests stay as rows with their status and no bundle; an admitted
    request whose class has no advice stays with status 500.
    """
    admitted = admit_images(requests).withColumn("season", D.season(F.col("selected_date")))
    bad_date = F.col("season").isNull()
    checked = admitted.withColumns(
        {
            "status": F.when(bad_date & (F.col("rejection").isNull()), 400).otherwise(F.col("status")),
            "rejection": F.when(
                F.col("rejection").isNull() & bad_date, F.lit("bad_date")
            ).otherwise(F.col("rejection")),
        }
    )
    # A refused request looks up no class, so one read of the source serves all rows.
    asked = checked.withColumn("_class", F.col("class_name")).withColumn(
        "class_name", F.when(F.col("rejection").isNull(), F.col("class_name"))
    )
    answered = result_bundle(asked, bundles, strict=False)
    missing = F.col("rejection").isNull() & ~F.col("found")
    return answered.withColumns(
        {
            "class_name": F.col("_class"),
            "status": F.when(missing, 500).otherwise(F.col("status")),
            "rejection": F.when(missing, "unknown_class").otherwise(F.col("rejection")),
        }
    ).drop("_class", "found")


def run_available(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None):
    """Process everything present, write Parquet and stop."""
    location = checkpoint or scratch_path(stream.sparkSession, "stream-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", location)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def latest_per_key(rows: DataFrame, key: str, seq: str, payload: Sequence[str]) -> DataFrame:
    """Newest row per key by sequence number; older answers are dropped."""
    newest = rows.groupBy(key).agg(
        F.max(seq).alias(seq), F.max_by(F.struct(*payload), F.col(seq)).alias("_p")
    )
    return newest.select(key, seq, *[F.col(f"_p.{c}").alias(c) for c in payload])


def newest_in_spans(
    stream: DataFrame, key: str, seq: str, payload: Sequence[str], event_time: str, delay: str, span: str
) -> DataFrame:
    """Newest row per key and time span, kept as stream state.

    The state holds one row per key and span of event time. A span is evicted once the watermark,
    ``delay`` behind the newest event, has passed it; what comes later for it is too late and is
    dropped by the state store.
    """
    # A watermark needs a time with a zone; a plain one is read in the session's.
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    newest = timed.groupBy(F.window(event_time, span).alias("_span"), key).agg(
        F.max(seq).alias(seq), F.max_by(F.struct(*payload), F.col(seq)).alias("_p")
    )
    return newest.select(key, seq, *[F.col(f"_p.{c}").alias(c) for c in payload])


class LatestTable:
    """One row per key in a folder: a base and a few deltas, one per micro-batch since.

    A batch writes ``delta=<number>`` and overwrites itself when it is tried again. After
    ``compact_every`` deltas they are merged into ``base=<number>`` and deleted, so neither files nor
    reading grow with the number of batches; a reader takes the newest finished base and the
    deltas after it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str, payload: Sequence[str], compact_every: int = 8):
        self.spark, self.path, self.every = spark, path, compact_every
        self.key, self.seq, self.payload = key, seq, list(payload)

    def _folders(self) -> tuple[int, list[int], list[int]]:
        """(newest finished base or -1, all bases, all deltas)."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        bases, deltas, finished = [], [], -1
        for status in system.listStatus(root) if system.exists(root) else []:
            kind, _, number = status.getPath().getName().partition("=")
            if kind == "base":
                bases.append(int(number))
                done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
                finished = max(finished, int(number)) if system.exists(done) else finished
            elif kind == "delta":
                deltas.append(int(number))
        return finished, bases, deltas

    def _live(self) -> list[str]:
        finished, _, deltas = self._folders()
        base = [f"{self.path}/base={finished}"] if finished >= 0 else []
        return base + [f"{self.path}/delta={n}" for n in sorted(deltas) if n > finished]

    def merge(self, batch: DataFrame, number: int) -> None:
        newest = latest_per_key(batch, self.key, self.seq, self.payload)
        newest.write.mode("overwrite").parquet(f"{self.path}/delta={number}")
        finished, _, deltas = self._folders()
        if len([n for n in deltas if n > finished]) >= self.every:
            self.compact(number)

    def compact(self, number: int) -> None:
        merged = latest_per_key(self.spark.read.parquet(*self._live()), self.key, self.seq, self.payload)
        merged.write.mode("overwrite").parquet(f"{self.path}/base={number}")
        finished, bases, deltas = self._folders()
        old = [f"base={n}" for n in bases if n < finished] + [f"delta={n}" for n in deltas if n <= finished]
        for name in old:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def read(self, schema: StructType) -> DataFrame:
        """The newest row of every key; a table without a batch is empty."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], schema)
        return latest_per_key(self.spark.read.schema(schema).parquet(*live), self.key, self.seq, self.payload)


def run_latest(
    stream: DataFrame,
    key: str,
    seq: str,
    payload: Sequence[str],
    path: str,
    event_time: str,
    delay: str = "1 day",
    span: str = "1 day",
    checkpoint: str | None = None,
    compact_every: int = 8,
) -> DataFrame:
    """Newest row per key of everything present: state per key and span, merged by key at the sink.

    An answer with a lower sequence number loses at the sink even when its span is gone from the
    state. Rows without a key or event time are left out. Equal to ``latest_per_key`` on the same
    rows as long as none is later than ``delay`` behind the watermark.
    """
    spark: SparkSession = stream.sparkSession
    rows = stream.filter(F.col(key).isNotNull() & F.col(event_time).isNotNull())
    newest = newest_in_spans(rows, key, seq, payload, event_time, delay, span)
    table = LatestTable(spark, path, key, seq, payload, compact_every)
    query = (
        newest.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .outputMode("update")
        .foreachBatch(table.merge)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read(newest.schema)
