"""Near-duplicate vectors: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

BLOCK = 512


def table_shape(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets of about 16 among n unrelated vectors, and as many tables as ``recall`` at ``cosine`` takes."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 2))) - 4))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


KEYS = ["dim", "t", "code", "low", "high"]


def _linked(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, codes: np.ndarray, block: np.ndarray, cosine: float):
    """Of a bucket (or two blocks of one): ids that have partners, their partners' weight, and the least id of their local group.

    A pair belongs to the first table in which its codes agree (``codes`` holds those of the tables before), so that
    no pair counts twice.
    """
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if block[0] != block[-1]:  # sorted: two blocks, of which only pairs across are new
        near &= block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return None
    fresh = ~(codes[a] == codes[b]).any(axis=1)
    a, b = a[fresh], b[fresh]
    root = ids.copy()
    while len(a):
        down = root.copy()
        np.minimum.at(down, a, root[b])
        if (down == root).all():
            break
        root = down
    links = np.bincount(a, weights=weight[b], minlength=len(ids)).astype(np.int64)
    found = links > 0
    return ids[found], links[found], root[found]


def _buckets(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Partial results of all buckets of a partition that is sorted by bucket; the last of a batch waits for the next."""
    out_schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    rest: pa.Table | None = None

    def solved(rows: pa.Table) -> pa.RecordBatch:
        ends = _edges(rows)
        columns = {n: rows[n].to_numpy() for n in ("dim", "t", "block", "cid", "weight")}
        found = []
        for lo, hi in zip(ends, ends[1:], strict=False):
            part = rows.slice(lo, hi - lo)
            block = columns["block"][lo:hi]
            if part["low"][0].as_py() != part["high"][0].as_py() and block[0] == block[-1]:
                continue  # one of the two blocks is empty
            dim, t = int(columns["dim"][lo]), int(columns["t"][lo])
            x = part["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            codes = part["codes"].combine_chunks().flatten().to_numpy().reshape(hi - lo, -1)[:, :t]
            if (got := _linked(x, columns["cid"][lo:hi], columns["weight"][lo:hi], codes, block, cosine)) is not None:
                found.append(got)
        arrays = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], schema=out_schema)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not len(rows):
            continue
        last = int(_edges(rows)[-2])
        rest = rows.slice(last)
        if last:
            yield solved(rows.slice(0, last))
    if rest is not None:
        yield solved(rest)


def _edges(rows: pa.Table) -> np.ndarray:
    """Where each run of equal bucket keys begins, and the end."""
    keys = np.stack([rows[k].to_numpy().astype(np.int64) for k in KEYS])
    return np.concatenate([[0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1, [len(rows)]])


def embedding_groups(
    vectors: DataFrame,
    cosine: float = 0.9,
    recall: float = 0.98,
    seed: int = 7,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Two vectors are linked if some table puts them into one bucket and their cosine in double precision is at
    least ``cosine``; a pair at that very cosine is found with the probability ``recall``, closer ones nearly always.
    Equal vectors are one class, counted, and never compared with each other. Buckets of over 512 classes are
    cut into blocks by hash, and each pair of blocks is a group of its own. A task works through its groups one by
    one, and returns sums and local groups, not pairs.

    Vectors that are null, zero or hold null or non-finite components link with nothing, as do rows without an id
    (whose component is null) and vectors of different lengths. Repeated ids are vectors of their own with one component.
    """
    scratch = Scratch(vectors.sparkSession)
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = F.coalesce(finite & F.exists(vec, lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("usable", usable)
    classes = rows.where("usable").groupBy("vec").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("weight"))
    bits, tables = table_shape(classes.count(), cosine, recall)

    @F.pandas_udf("array<int>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits)
        for s in batches:
            out = []
            for v in s:
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng([seed, len(v)]).standard_normal((tables * bits, len(v)))
                signs = planes[len(v)] @ np.asarray(v, np.float64) > 0
                out.append((signs.reshape(tables, bits) @ powers).astype(np.int32))
            yield pd.Series(out)

    coded = scratch.save(classes.withColumn("codes", codes("vec")))
    slots = coded.select("cid", F.size("vec").alias("dim"), F.posexplode("codes").alias("t", "code"))
    sizes = slots.groupBy("dim", "t", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (
        slots.join(sizes, ["dim", "t", "code"])
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cid", "dim", "t", "code", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    found = scratch.save(
        placed.join(coded, "cid")
        .repartition(*KEYS)
        .sortWithinPartitions(*KEYS, "block", "cid")
        .select(*KEYS, "block", "cid", "weight", "codes", "vec")
        .mapInArrow(lambda batches: _buckets(batches, cosine), "cid long, links long, root long")
    )
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    summed = (
        classes.join(links, "cid", "left")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .select(
            F.col("vec"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
            F.coalesce("root", "cid").alias("component"),
        )
    )
    alone = rows.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = rows.where("usable").join(summed, "vec").select("vec_id", F.col("links"), F.col("component"))
    return linked.union(alone).toDF("vec_id", "n_links", "component_id").withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
