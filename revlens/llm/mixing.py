"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORDS, Scratch

SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _unit(*cols: Column) -> Column:
    """32 bits of an MD5 as a long: SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def target_sizes(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from one row a source (source, source_size).

    Sources in code-point order, null last, weigh ``weights``, repeating, and share the sum of all sizes. A
    target stops at ``most`` times its source's size; the rest is shared anew by weight among the others until
    none is above. Each round is one aggregate over the sources; at most as many rounds as sources run,
    in practice a handful.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # rows: sources, not documents
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    rows = scratch.save(rows.withColumn("full", F.col("source_size") <= 0))
    while True:
        total, taken, weight = rows.agg(
            F.sum("source_size"),
            F.sum(F.when(F.col("full"), F.col("source_size") * most)),
            F.sum(F.when(~F.col("full"), F.col("weight"))),
        ).first()
        left = (total or 0) - (taken or 0.0)
        share = F.col("weight") * (left / weight if weight else 0.0)
        above = ~F.col("full") & (share > F.col("source_size") * most)
        if not weight or not rows.where(above).limit(1).count():
            break
        rows = scratch.save(rows.withColumn("full", F.col("full") | above))
    target = F.when(F.col("full"), F.col("source_size") * most).otherwise(share)
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: float = 3.0,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str | None = None,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``: how often the mix takes each document.

    A document's expected copies are target / source_size, alike within its source. They are summed up over
    the source's documents, in the order of size, from one offset in [0, 1) a source; a document is emitted once for
    every integer its stretch of that sum crosses. Its rank, and so the sum, is exact without sorting a source in one
    task: documents are counted by (source, square root of the size, one of 64 hash salts), a window over
    those counts gives the ranks before each bin, and a window within each bin the rest.

    Null text has size 0. A null source is a source of its own. Ties are ordered by id, size and a hash of the
    text, so reruns agree; identical rows share their places. No document is taken more than
    ceil(most) times. Extra columns of docs stay; the four named above are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    size = F.col(size_col).cast("long") if size_col else n_words(F.col(text_col))
    salt = _unit(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(str(seed))) % SALTS
    tie = F.xxhash64(text_col) if text_col in docs.columns else F.lit(0)
    keyed = docs.drop("source_size", "target", "copies").withColumns({"size": size})
    keyed = keyed.withColumns({"__bin": F.floor(F.sqrt(F.col("size"))), "__salt": salt, "__src": F.col(source_col)})
    bins = scratch.save(
        keyed.groupBy("__src", "__bin", "__salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    )
    per_source = bins.groupBy(F.col("__src").alias("source")).agg(F.sum("words").alias("source_size"))
    targets = target_sizes(per_source, scratch, weights, most)
    before = Window.partitionBy("__src").orderBy("__bin", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = _unit(F.coalesce("source", F.lit("-")), F.lit(str(seed)), F.lit("offset")) / float(1 << 32)
    starts = (
        bins.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(targets, F.col("__src").eqNullSafe(F.col("source")))
        .select(
            *[F.col(c).alias(f"{c}0") for c in ("__src", "__bin", "__salt")],
            "__before",
            "source_size",
            "target",
            offset.alias("__offset"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"),
        )
    )
    within = Window.partitionBy("__src", "__bin", "__salt").orderBy(id_col, "size", tie)
    ranked = keyed.withColumn("__rank", F.row_number().over(within)).join(
        starts,
        F.col("__src").eqNullSafe(F.col("__src0")) & (F.col("__bin") == F.col("__bin0")) & (F.col("__salt") == F.col("__salt0")),
    )
    last = F.col("__before") + F.col("__rank")
    crossed = F.floor(F.col("__offset") + last * F.col("__rate")) - F.floor(
        F.col("__offset") + (last - 1) * F.col("__rate")
    )
    ranked = ranked.withColumn("copies", crossed.cast("long"))
    return ranked.drop(*[c for c in ranked.columns if c.startswith("__")])


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy, ``copy`` counting from 1; documents with no copies go."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
