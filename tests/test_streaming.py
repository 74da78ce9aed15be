"""Stream state and its table against the batch form."""

import datetime
import os

from pyspark.sql import functions as F

from splitwarden.operators.scale import scratch_path
from splitwarden.streaming import requests as RQ

SCHEMA = "session long, seq long, ts timestamp, event_type string, value double"


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n, hours=hour)


def write_batches(spark, folder, batches):
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={i}")
        found = next(f for f in os.listdir(f"{folder}/part={i}") if f.endswith(".parquet"))
        os.link(f"{folder}/part={i}/{found}", f"{folder}/{i:04d}.parquet")


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def latest(spark, folder, path, **more):
    return RQ.run_latest(stream_of(spark, folder), "session", "seq", ["event_type", "value"], path, "ts", **more)


def test_state_and_batch_agree_and_files_do_not_pile_up(spark, tmp_path):
    batches = [[(s, 100 * b + s, day(b, s), f"e{b}", float(b)) for s in range(b % 3, 6)] for b in range(9)]
    batches[4].append((0, 5, day(4), "old answer", -1.0))  # a lower number comes later
    batches[5].append((None, 9_999, day(5), "no key", 0.0))
    write_batches(spark, str(tmp_path / "in"), batches)
    path = scratch_path(spark, "latest-test")
    found = latest(spark, str(tmp_path / "in"), path, compact_every=3)
    rows = spark.createDataFrame([r for b in batches for r in b if r[0] is not None], SCHEMA)
    want = RQ.latest_per_key(rows, "session", "seq", ["event_type", "value"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    table = RQ.LatestTable(spark, path, "session", "seq", ["event_type", "value"])
    finished, bases, deltas = table._folders()
    assert bases == [finished] and len([n for n in deltas if n > finished]) <= 3 and len(deltas) <= 3
    # A batch that is tried again changes nothing.
    again = spark.createDataFrame([(0, 1, "x", 0.0)], "session long, seq long, event_type string, value double")
    table.merge(again, max([finished, *deltas]))
    assert table.read(found.schema).filter("session = 1").collect() == want.filter("session = 1").collect()


def test_late_rows_are_dropped_and_spans_evicted(spark, tmp_path):
    batches = [[(1, 10, day(0), "a", 0.0), (2, 11, day(0), "b", 0.0)], [(1, 20, day(10), "c", 0.0)], [(1, 21, day(10), "d", 0.0)],
               [(2, 99, day(0), "too late", 0.0)], [(1, 22, day(11), "e", 0.0)]]
    write_batches(spark, str(tmp_path / "in"), batches)
    stream = RQ.newest_in_spans(stream_of(spark, str(tmp_path / "in")), "session", "seq", ["event_type"], "ts", "1 day", "1 day")
    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", scratch_path(spark, "late-state"))
        .format("memory").queryName("late").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    assert states[-1]["numRowsTotal"] < 4 and sum(s["numRowsRemoved"] for s in states) >= 2
    newest = spark.table("late").groupBy("session").agg(F.max("seq").alias("seq"))
    assert sorted(map(tuple, newest.collect())) == [(1, 22), (2, 11)]


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    found = RQ.run_latest(stream, "session", "seq", ["event_type", "value"], scratch_path(spark, "none"), "ts")
    assert found.columns == ["session", "seq", "event_type", "value"] and found.count() == 0
