"""Helpers shared by the training-data operators: scratch tables and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for the fold ``crc32(doc_id as text) mod modulus = remainder`` (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_share(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, for samples that reruns repeat."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / float(1 << 53)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); where unset, and all of Spark is one process (tests), one of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="revlens-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and lost executors cost no rerun."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{scratch_root(spark)}/revlens-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again. Shuffle files of steps that are over are let go, to bound the disk in use."""
        path = f"{self.folder}/{self.made}"
        self.made += 1
        self.collect()  # what was still held at the end of the step before
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        self.collect()
        return back

    def collect(self) -> None:
        """Spark removes the files of unreachable shuffles on collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that is not the smallest of its component; ``edges`` holds long ids.

    Large-star and small-star steps in turn: every node's larger neighbours, then every node with its
    smaller ones, are hung on the least id near it, until nothing changes. Each round is grouping with
    partial aggregation and two joins, and is written to the shared folder. Ids never reach the driver.
    """

    def lowest(e: DataFrame) -> DataFrame:
        return e.join(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = mark(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        near = lowest(large)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = scratch.save(small.union(near.select("u", F.col("m").alias("v"))).distinct())
        after = mark(step)
        scratch.drop(now)
        scratch.drop(large)
        now = step
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
