"""Folds over rows in order, a group after the other, that hold one small state at a time; and tables cut loose from their lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a folder of its own only where all of Spark is one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        root = context.getConf().get("spark.checkpoint.dir")
        if root is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="revlens-")
        context.setCheckpointDir(root)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and cut loose from what made it."""
    shared_root(df.sparkSession)
    return df.checkpoint()


class Fold(Protocol):
    """The state of one group."""

    def take(self, rows: pa.Table) -> list[tuple]:
        """The next rows of the group; what they give so far."""

    def end(self) -> list[tuple]:
        """What the group gives at its end."""


class Assign:
    """Pairs (``old, new``) taken in order, each side once; holds what is taken."""

    def __init__(self):
        self.old: set = set()
        self.new: set = set()

    def take(self, rows: pa.Table) -> list[tuple]:
        out = []
        for o, n in zip(rows["old"].to_pylist(), rows["new"].to_pylist(), strict=True):
            if o not in self.old and n not in self.new:
                self.old.add(o)
                self.new.add(n)
                out.append((o, n))
        return out

    def end(self) -> list[tuple]:
        return []


def fold(df: DataFrame, by: list[str], order: list[str], start: Callable[[], Fold], schema: str) -> DataFrame:
    """Rows (``by``, then ``schema``'s columns) of a fold over each group of ``df`` in ``order``.

    Groups are dealt out by key and sorted by Spark; a task goes through them batch by batch and keeps a group's state only, so that
    a group of any size needs no more memory than another. Order within a group is what such a fold is about, so a group is one task's.
    """
    keys = df.select(*by).schema
    made = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in keys) + schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out_schema: pa.Schema | None = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if out_schema is None:
                out_schema = _arrow(batch.schema, by, schema)
            if not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            for k in by:
                c = rows[k].combine_chunks()
                a, b = c.slice(1), c.slice(0, len(c) - 1)
                same = pa.compute.fill_null(pa.compute.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
                new[1:] |= ~same
            edges = [0, *np.flatnonzero(new).tolist(), len(rows)]
            made_rows: list[tuple] = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = rows.slice(lo, hi - lo)
                own = tuple(part[k][0].as_py() for k in by)
                if state is None or own != key:
                    if state is not None:
                        made_rows += [key + r for r in state.end()]
                    key, state = own, start()
                made_rows += [key + r for r in state.take(part)]
            yield out(made_rows)
        if state is not None:
            yield out([key + r for r in state.end()])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(work, made)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(schema: pa.Schema, by: list[str], made: str) -> pa.Schema:
    fields = [schema.field(k) for k in by]
    for part in made.split(","):
        name, kind = part.split()
        fields.append(pa.field(name, _TYPES[kind]))
    return pa.schema(fields)
