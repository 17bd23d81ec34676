"""Streaming forms of the state operators: latest rows, synchronised snapshots, duplicates within a time, counts by window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from revlens.operators.folds import checkpointed

BUCKETS = 64


def latest_state(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's latest event by ``order``; a stream of updates, its state a row a key (:func:`revlens.operators.state.latest_state` in batch)."""
    last = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("last")
    return events.groupBy(*keys).agg(last).select(*keys, *[f"last.{v}" for v in values])


def first_within(events: DataFrame, keys: list[str], when: str, within: str) -> DataFrame:
    """Events of which none with the same keys came up to ``within`` before; keys are forgotten once the watermark has passed, so state is bounded by that time."""
    return events.withWatermark(when, within).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, when: str, width: str, late: str, *by: Column) -> DataFrame:
    """``start, by..., n``: events by window of time and other columns; those over ``late`` behind are left out, and their windows closed."""
    n = events.withWatermark(when, late).groupBy(F.window(when, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("start"), *[c for c in n.columns if c not in ("w", "n")], "n")


def _read(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A snapshot with its buckets; none where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge_latest(batch: DataFrame, folder: str, key: str, version: str) -> None:
    """Puts a batch into the snapshot in ``folder``: of each key the row of the highest version stays, the stored one where they are equal; rows without a key or version are passed over.

    The snapshot lies in 64 folders by the key's hash; only those that the batch touches are read and written anew, from a copy in the shared folder. Merging a batch twice changes nothing, so a batch that is replayed after a failure does no harm.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")
    new = checkpointed(batch.where(F.col(key).isNotNull() & F.col(version).isNotNull()).withColumns({"bucket": bucket, "__stored": F.lit(0)}))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # 64 numbers at most
    if not touched:
        return
    columns = batch.columns
    stored = _read(spark, folder, new.select(*columns, "bucket").schema).where(F.col("bucket").isin(touched)).withColumn("__stored", F.lit(1))
    both = new.select(*columns, "bucket", "__stored").union(stored.select(*columns, "bucket", "__stored"))
    rest = [c for c in columns if c not in (key, version)]
    last = both.groupBy(key, "bucket").agg(F.max(F.struct(version, "__stored", *rest)).alias("last"))
    merged = checkpointed(last.select(*[F.col(key) if c == key else F.col(f"last.{c}").alias(c) for c in columns], "bucket"))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def keep_snapshot(events: DataFrame, folder: str, key: str, version: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A running query that keeps the snapshot in ``folder`` at the last version of every key (last writer wins); ``once``: of what is there now, then it ends."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_latest(batch, folder, key, version))
    return (writer.trigger(availableNow=True) if once else writer).start()
