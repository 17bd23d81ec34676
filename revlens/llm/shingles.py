"""Near-copies of documents by an exact set-similarity join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, connected_components
from .simhash import set_fingerprint, simhash_links

SLOTS = 1 << 20
STEPS = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, ascending; of a text with fewer words that of all of them."""
    words = (text or b"").lower().split()  # bytes: only A-Z, and only the six ASCII breaks
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
    long = min(width, len(words))
    mixed = np.full(len(words) - long + 1, long, np.uint64)
    for i in range(long):
        mixed += h[i : i + len(mixed)] * STEPS[i]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * STEPS[-1]
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def _least(n: Column, share: float) -> Column:
    """Smallest whole number that is at least share * n."""
    return F.ceil(n * share - 1e-9).cast("int")


def hashes(text: Column, width: int) -> Column:
    """:func:`shingle_set` as an array of longs."""

    @F.pandas_udf("array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([shingle_set(t, width).view(np.int64) for t in s], dtype="object")

    return made(text.cast("binary"))


def rarity_table(docs: DataFrame, width: int) -> np.ndarray:
    """How common shingles are: a byte for each of 1,048,576 hash slots, twice the binary logarithm of its count.

    Counts are taken over all documents (id, text). Any order of the shingles makes the join exact; this one makes it
    cheap, as shingles that many documents share come last.
    """
    some = docs.select(F.explode(hashes(F.col("text"), width)).alias("h"))
    slots = some.groupBy(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    shade = F.least(F.floor(2 * F.log2("n")) + 1, F.lit(255))
    packed = slots.select(F.shiftright("slot", 10).alias("block"), (F.col("slot") * 256 + shade).alias("v"))
    table = np.zeros(SLOTS, np.uint8)
    for row in packed.groupBy("block").agg(F.collect_list("v").alias("v")).toLocalIterator():
        v = np.array(row.v, np.int64)
        table[v >> 8] = v & 255
    return table


def _fronts(spark: SparkSession, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``id, key, n, fp, front``: of each set a digest, its size, its SimHash, and its rarest shingles, of which similar sets share one."""
    rarity = spark.sparkContext.broadcast(rarity_table(docs, width))

    @F.pandas_udf("key binary, n int, fp long, front array<long>")
    def front(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = rarity.value
        for s in batches:
            rows = []
            for text in s:
                own = shingle_set(text, width)
                n = len(own)
                take = n - int(np.ceil(n * similarity - 1e-9)) + 1 if n else 0
                order = np.argsort(table[own & np.uint64(SLOTS - 1)], kind="stable")[:take]  # equal ones by hash
                rows.append((xxhash.xxh3_128_digest(own.tobytes()), n, set_fingerprint(own), own[order].view(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "n", "fp", "front"])

    made = docs.select("id", F.explode(F.array(front(F.col("text").cast("binary")))).alias("f"))
    return made.select("id", "f.key", "f.n", "f.fp", "f.front")


def near_groups(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1
) -> DataFrame:
    """``id, root`` for every id that is not the smallest of its group; rows without an id are ignored.

    Two documents are linked where the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``similarity``; groups are the components. Wordless texts are alike. Shingles are compared by 64-bit hashes.

    Equal sets form a class, so copies make no pairs. Classes whose SimHash fingerprints are within two bits (pigeonring-filtered
    segments, :func:`.simhash.simhash_links`) are held against each other on the whole sets first. At a similarity of 0.8
    fingerprints of 64 bits are some ten bits apart, too far for any selective segments, so the rest is found by a prefix
    filter: similar sets share one of the rare shingles at their fronts. Of the classes that share a shingle, each outside the
    most frequent group among them is first held against the least of that group, for the group with which it shares most
    (``rounds`` times, groups growing meanwhile). Pairs are then made only across groups, between those outside the most
    frequent group and all others, where their fronts share enough, and held against each other on the whole sets. So a large group of near copies makes about
    as many pairs as it has members, and no link is lost.

    Null and empty texts are wordless. Repeated rows are copies; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = scratch.save(_fronts(spark, docs, width, similarity))
    classes = scratch.save(signed.groupBy("key").agg(F.min(F.struct("id", "n", "fp", "front")).alias("f")).select("key", "f.*"))
    firsts = classes.select("key", F.col("id").alias("b"))
    equal = scratch.save(signed.select("id", "key").join(firsts, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    scratch.drop(signed)
    entries = classes.select(F.col("id").alias("rep"), "n", F.explode("front").alias("w"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("w")) > 1
    crowd = scratch.save(entries.withColumn("shared", shared).where("shared").drop("shared"))
    prints = scratch.save(classes.select(F.col("id").alias("rep"), "fp"))
    scratch.drop(classes)

    def may_match(met: Column, n: Column, m: Column) -> Column:
        """Shingles that aren't common to both fronts are common only if they lie behind the front of one of the sets."""
        behind = F.greatest(_least(n, similarity), _least(m, similarity)) - 1
        return (F.least(n, m) >= _least(F.greatest(n, m), similarity)) & (met + behind >= _least(n + m, similarity / (1 + similarity)))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs)
        needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        whole = docs.join(needed, "id", "left_semi").select("id", F.explode(F.array(hashes(F.col("text"), width))).alias("set"))
        whole = scratch.save(whole)  # repeated ids: any of their texts may match
        both = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        close = both.where(common >= _least(F.size("x") + F.size("y") - common, similarity)).select("a", "b").distinct()
        close = scratch.save(close)
        scratch.drop(whole)
        return close

    def grouped(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Classes that share a shingle across groups, with their groups; the least class of the most frequent one."""
        roots = connected_components(links, scratch)
        at = crowd.join(roots, F.col("rep") == F.col("node"), "left").select("w", "rep", "n", F.coalesce("root", "rep").alias("root"))
        counts = at.groupBy("w", "root").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rep", "n")).alias("hub"))
        main = counts.groupBy("w").agg(F.max(F.struct("m", -F.col("root"), "hub", "root")).alias("t"), F.count(F.lit(1)).alias("k"))
        main = main.where("k > 1").select("w", F.col("t.root").alias("main"), F.col("t.hub").alias("hub"))
        at = scratch.save(at.join(main, "w"))
        return at, at.where("root <> main")

    leaders = prints.groupBy("fp").agg(F.min("rep").alias("rep"))
    alike = prints.join(leaders.withColumnRenamed("rep", "b"), "fp").where("rep <> b").select(F.col("rep").alias("a"), "b")
    links = scratch.save(equal.union(verified(alike.union(simhash_links(leaders, scratch)))))
    for _ in range(rounds):
        at, strays = grouped(links)
        likely = strays.groupBy("rep", "n", "hub").agg(F.count(F.lit(1)).alias("met"))
        likely = likely.where(may_match(F.col("met"), F.col("n"), F.col("hub.n")))
        likely = likely.groupBy(F.col("rep").alias("a")).agg(F.max_by("hub.rep", F.struct("met", -F.col("hub.rep"))).alias("b"))
        links = scratch.save(links.union(verified(likely)))
        scratch.drop(at)
    at, strays = grouped(links)
    x, y = strays.alias("x"), at.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    fits = (
        (F.col("x.w") == F.col("y.w"))
        & (F.col("x.root") != F.col("y.root"))
        & ((F.col("y.root") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & (F.least(n, m) >= _least(F.greatest(n, m), similarity))
    )  # a pair across groups meets once at each shingle that it shares
    met = x.join(y, fits).groupBy(
        F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b"), F.least(n, m).alias("n"), F.greatest(n, m).alias("m")
    )
    pairs = met.agg(F.count(F.lit(1)).alias("met")).where(may_match(F.col("met"), F.col("n"), F.col("m"))).select("a", "b")
    links = scratch.save(links.union(verified(pairs)))
    return connected_components(links, scratch).select(F.col("node").alias("id"), "root")


def near_dedup(
    docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without those whose group (see :func:`near_groups`) has a smaller id; columns and repeated rows of kept ids stay.

    Rows without an id can't be told apart and stay.
    """
    gone = near_groups(docs, similarity, width, id_col, text_col).select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
