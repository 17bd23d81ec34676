"""Records for retrieval: adapters, scoping of ranked hits, query stores, label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_records(df: DataFrame, key: Column, text: Column, source: str | Column, **metadata: Column) -> DataFrame:
    """``id, text, source, metadata`` of rows with a text; the metadata map leaves unknown values out."""
    source = F.lit(source) if isinstance(source, str) else source
    items = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in sorted(metadata.items())]), lambda p: p["v"].isNotNull())
    rows = df.select(key.cast("string").alias("id"), F.trim(text).alias("text"), source.alias("source"), F.map_from_entries(items).alias("metadata"))
    return rows.where(F.length("text") > 0)


def unretracted(df: DataFrame, retracted: str) -> DataFrame:
    """Rows whose retraction time is not set."""
    return df.where(F.col(retracted).isNull())


def scoped_hits(hits: DataFrame, rows: DataFrame, key: str, query: str, rank: str, scope: Column, k: int, over: int = 4) -> DataFrame:
    """Rows of the first ``over * k`` hits of a query that are in scope, at most k, in the order of their ranks (place from 1)."""
    near = hits.where(F.col(rank) <= over * k).join(rows, key).where(scope)
    place = F.row_number().over(Window.partitionBy(query).orderBy(rank, key))
    return near.withColumn("place", place).where(F.col("place") <= k)


def add_queries(store: DataFrame, new: DataFrame, text: str, order: str, origin: str) -> DataFrame:
    """The store with new queries whose text it lacks (blanks and case aside), once each; those without an origin are left out."""
    key = F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    wanted = new.where(F.coalesce(F.col(origin) != "", F.lit(False))).withColumn("_key", key)
    first = Window.partitionBy("_key").orderBy(order)
    wanted = wanted.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    held = store.select(key.alias("_key")).distinct()
    return store.unionByName(wanted.join(held, "_key", "left_anti").drop("_key"))


def heading_labels(records: DataFrame, key: str, section: str) -> DataFrame:
    """``query, relevant``: each heading as a query for the records beneath it; headings of one record only, and no others."""
    return records.where(F.coalesce(F.col(section) != "", F.lit(False))).groupBy(F.col(section).alias("query")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("relevant")
    ).where("n = 1").drop("n")


def human_only(labels: DataFrame, origin: str, synthetic: bool = False) -> DataFrame:
    """Labels that people made; synthetic ones only where asked for."""
    return labels if synthetic else labels.where(F.coalesce(F.col(origin) != "synthetic", F.lit(True)))


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and a digest of their contents that no order of rows or partitions changes.

    Each row's canonical text (columns by name, nulls marked) is hashed, and the sums of the hashes' quarters are hashed again.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(columns)])
    h = F.md5(line)
    parts = [F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("long")).cast("string") for i in (1, 9, 17, 25)]
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("0")) for p in parts]), 256).alias("digest"))


def settled_labels(events: DataFrame, key: str, verdict: str, order: str) -> DataFrame:
    """The last verdict on each key: sets of matched and of changed texts don't overlap, whatever was said before."""
    return events.groupBy(key).agg(F.max_by(verdict, order).alias(verdict))


def balance(labels: DataFrame, verdict: str, least: float) -> DataFrame:
    """Rows and share of each verdict, and whether the rarest one's share is enough to learn from."""
    n = labels.groupBy(verdict).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.min("n").alias("_least"))
    return n.join(F.broadcast(total)).select(verdict, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"), (F.col("_least") / F.col("_all") >= least).alias("enough"))  # one row
