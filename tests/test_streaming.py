"""Streams in several batches against the batch forms over all events."""

import datetime
import random

from pyspark.sql import functions as F

from revlens.operators import state
from revlens.streaming import twins

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"


def written(spark, folder, n=4):
    """Events in n files, and all of them as a table."""
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, rng.choice([1, 2, 3, 40, None]), start + datetime.timedelta(seconds=30 * k + rng.randrange(20)), rng.choice("abc")) for k in range(200)]
    for i in range(n):
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, SCHEMA), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream, name, mode, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_latest_state_of_a_stream(spark, tmp_path):
    events, stream = written(spark, f"file://{tmp_path}/events")
    got = drained(twins.latest_state(stream, ["user_id"], ["ts", "event_id"], ["event_type"]), "latest", "complete", tmp_path)
    want = state.latest_state(events, ["user_id"], ["ts", "event_id"], ["event_type"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)


def test_snapshot_is_that_of_the_last_writers_and_replays_do_no_harm(spark, tmp_path):
    events, stream = written(spark, f"file://{tmp_path}/events")
    folder = f"file://{tmp_path}/snapshot"
    twins.keep_snapshot(stream, folder, "user_id", "event_id", f"file://{tmp_path}/cp", once=True).awaitTermination(240)
    want = sorted((r.user_id, r.v) for r in events.where("user_id is not null").groupBy("user_id").agg(F.max("event_id").alias("v")).collect())
    rows = lambda: sorted((r.user_id, r.event_id) for r in spark.read.parquet(folder).collect())
    assert rows() == want
    old = events.where("event_id < 60")
    twins.merge_latest(old, folder, "user_id", "event_id")
    assert rows() == want
    twins.merge_latest(events.where("false"), folder, "user_id", "event_id")
    late = spark.createDataFrame([(999, 2, None, "z"), (None, 3, None, "x"), (5, None, None, "x")], SCHEMA)
    twins.merge_latest(late, folder, "user_id", "event_id")
    assert dict(rows()) == dict(want) | {2: 999}


def test_duplicates_and_windows(spark, tmp_path):
    events, stream = written(spark, f"file://{tmp_path}/events")
    events, stream = (df.where("user_id is not null") for df in (events, stream))
    first = drained(twins.first_within(stream, ["user_id", "event_type"], "ts", "1 day"), "firsts", "append", tmp_path)
    assert first.count() == events.select("user_id", "event_type").distinct().count()
    counted = drained(twins.window_counts(stream, "ts", "10 minutes", "1 day", F.col("event_type")), "counts", "complete", tmp_path)
    want = events.groupBy(F.window("ts", "10 minutes").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
