"""Ordered operators: top-k, fusion, banding, chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays in double precision; null where one is zero."""

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; ties by id."""
    if len(scores) > k:
        near = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, least: float = 0.0, at_once: int = 20_000) -> DataFrame:
    """``query_id, vec_id, score, rank``: the k best vectors (vec_id, vec) of each query (query_id, q), above ``least``.

    Exact, in double precision. About ``at_once`` queries are sent to the tasks at a time, whatever their number; each such
    slice reads the vectors once, as blocks of products, and keeps k for each query of a batch. Null and zero vectors have no
    cosine. Vectors aren't shuffled.
    """
    known = queries.where(F.col("q").isNotNull())
    slices = max(1, -(-known.count() // at_once))

    def scorer(rows: list) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        own = np.array([r["query_id"] for r in rows], np.int64)
        q = np.array([r["q"] for r in rows], np.float64).reshape(len(rows), -1)

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            norm = np.sqrt((q * q).sum(1, keepdims=True))
            unit = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
            for b in batches:
                b = b[b["vec"].notna()]
                if not len(b) or not len(own):
                    continue
                x = np.stack(b["vec"].to_numpy()).astype(np.float64)
                ids = b["vec_id"].to_numpy(np.int64)
                size = np.sqrt((x * x).sum(1, keepdims=True))
                x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
                for at in range(0, len(own), 256):
                    products = np.round(unit[at : at + 256] @ x.T, 6)
                    products[own[at : at + 256, None] == ids[None, :]] = -np.inf
                    for one, row in zip(own[at : at + 256], products, strict=True):
                        top = _best(row, ids, k)
                        top = top[row[top] > least]
                        yield pd.DataFrame({"query_id": one, "vec_id": ids[top], "score": row[top]})

        return scored

    out = None
    for s in range(slices):
        rows = known.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s).select("query_id", "q").collect()  # about at_once
        part = vectors.select("vec_id", "vec").mapInPandas(scorer(rows), "query_id long, vec_id long, score double")
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def count_map_cosine(counts: DataFrame, group: str, item: str, n: str, of: Column, k: int) -> DataFrame:
    """The k groups whose item counts are the most like those of the group ``of``, by cosine at four places.

    Missing items count 0; a zero vector has similarity 0.
    """
    norm = counts.groupBy(group).agg(F.sqrt(F.sum(F.col(n).cast("double") * F.col(n))).alias("norm"))
    own = counts.where(of).select(item, F.col(n).alias("own"))
    own_norm = F.broadcast(own.agg(F.sqrt(F.sum(F.col("own").cast("double") * F.col("own"))).alias("own_norm")))  # one row
    dots = counts.join(own, item).groupBy(group).agg(F.sum(F.col(n).cast("double") * F.col("own")).alias("dot"))
    score = F.coalesce(F.round(F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("norm") * F.col("own_norm")), 4), F.lit(0.0))
    ranked = norm.join(dots, group, "left").join(own_norm).where(~of).select(group, score.alias("score"))
    return ranked.orderBy(F.desc("score"), group).limit(k)


def reciprocal_rank_fusion(rankings: list[DataFrame], by: list[str], item: str, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over rankings (by, item, rank), with the fused rank; ties by item."""
    every = rankings[0]
    for r in rankings[1:]:
        every = every.unionByName(r)
    fused = every.groupBy(*by, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), item)))


def runner_up(df: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """Best row of each group with its margin over the next; null where there is none."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return (
        df.withColumns({"_n": F.row_number().over(w), "_next": F.lead(score).over(w)})
        .where("_n = 1")
        .select(*by, order, score, (F.col(score) - F.col("_next")).alias("margin"))
    )


def banded(df: DataFrame, by: list[str], value: str, gap: float, order: str) -> DataFrame:
    """``df`` with ``band``: a new one begins where a value is over ``gap`` from the one before."""
    w = Window.partitionBy(*by).orderBy(value, order)
    new = (F.col(value) - F.lag(value).over(w) > gap).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("band", F.sum("_new").over(w)).drop("_new")


def pitch(df: DataFrame, by: list[str], value: str, places: int = 3) -> DataFrame:
    """Upper median of the positive gaps between distinct rounded values."""
    from .matching import upper_median

    distinct = df.select(*by, F.round(value, places).alias("v")).where("v is not null").distinct()
    w = Window.partitionBy(*by).orderBy("v")
    gaps = distinct.withColumn("gap", F.round(F.col("v") - F.lag("v").over(w), places)).where("gap > 0")
    return gaps.groupBy(*by).agg(upper_median(F.collect_list("gap")).alias("pitch"), F.count(F.lit(1)).alias("n"))


def columns_by_step(df: DataFrame, by: list[str], value: str, share: float = 0.25) -> DataFrame:
    """One-dimensional clusters cut where a step is over ``share`` of the group's largest; mean and size of each."""
    w = Window.partitionBy(*by).orderBy(value)
    step = df.select(*by, value, (F.col(value) - F.lag(value).over(w)).alias("step"))
    largest = F.max("step").over(Window.partitionBy(*by))
    cut = F.coalesce((F.col("step") > share * F.col("largest")).cast("int"), F.lit(0))
    marked = step.withColumn("largest", largest).withColumn("col", F.sum(cut).over(w))
    return marked.groupBy(*by, "col").agg(F.round(F.avg(value), 6).alias("center"), F.count(F.lit(1)).alias("n"))


def best_by(df: DataFrame, by: list[str], order: list[str], id_col: str) -> DataFrame:
    """The row id with the greatest (order..., id) of each group."""
    return df.groupBy(*by).agg(F.max(F.struct(*order, id_col)).alias("b")).select(*by, *[f"b.{c}" for c in order], F.col(f"b.{id_col}").alias(id_col))


def natural_key(text: Column) -> tuple[Column, Column, Column]:
    """Sort keys: texts with a number first, by that number, then by text."""
    digits = F.regexp_extract(text, r"\d+", 0)
    return F.when(digits == "", 1).otherwise(0), F.try_to_number(digits, F.lit("999999999999")).cast("long"), text


def placed(df: DataFrame, keys: list[Column], id_col: str, name: str = "place") -> DataFrame:
    """``id_col, name``: every row's place from 1 in the order of ``keys`` and then the id.

    A range-partitioned sort; the rows of each range are counted and the counts of those before it added.
    """
    rows = df.orderBy(*keys, id_col).select(id_col)
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {name} long"
    numbered = rows.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1))
    return df.sparkSession.createDataFrame(numbered, schema)


def chain(df: DataFrame, by: list[str], order: list[str], id_col: str) -> DataFrame:
    """``df`` with the row before it in its group and whether it is the last."""
    w = Window.partitionBy(*by).orderBy(*order, id_col)
    return df.withColumns({"previous": F.lag(id_col).over(w), "is_latest": F.lead(id_col).over(w).isNull()})


def recent_groups(df: DataFrame, by: list[str], group: str, order: str, most: int) -> DataFrame:
    """The latest rows of each log, ``most`` at most, cut at a group's edge: a group that doesn't fit whole goes."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    numbered = df.withColumn("_n", F.row_number().over(w))
    last = F.max("_n").over(Window.partitionBy(*by, group))
    return numbered.withColumn("_last", last).where(F.col("_last") <= most).drop("_n", "_last")


def stacked(df: DataFrame, by: list[str], y: str, order: str, most: int, text: str) -> DataFrame:
    """The top ``most`` values of each stack, joined from the top down."""
    w = Window.partitionBy(*by).orderBy(F.desc(y), order)
    top = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda s: s[text])
    return top.groupBy(*by).agg(F.array_join(lines, " / ").alias("stack"))
