"""Scores of predictions against labels: tiered matching, recall by kind, attribution, corpus status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Assign, checkpointed, fold
from .matching import grid_join

NEAR = 35.0  # fixed value: how far a prediction may lie from a label that it is matched with by place

def _paired(labels: DataFrame, found: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """``label_id, found_id, tier``: of each key the first label with the first prediction, the second with the second."""
    sides = []
    for df, own in ((labels, "label_id"), (found, "found_id")):
        known = df.where(F.col(keys[-1]).isNotNull() & (F.col(keys[-1]) != ""))
        sides.append(known.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(own))).select(*keys, "_n", own))
    return sides[0].join(sides[1], [*keys, "_n"]).select("label_id", "found_id", F.lit(tier).alias("tier"))


def tiered_matches(labels: DataFrame, found: DataFrame, within: str = "pair_id", tiers: tuple[str, ...] = ("handle", "text")) -> DataFrame:
    """``label_id, found_id, tier``: labels with predictions of the same pair, each used once, tier by tier.

    A tier is a column on which both agree; null and empty values agree with nothing. Within a key the first label takes
    the first prediction, which is what going through the labels in order gives. What is left goes to the next tier.
    """
    out = None
    for tier in tiers:
        if out is not None:
            labels, found = labels.join(out, "label_id", "left_anti"), found.join(out, "found_id", "left_anti")
        new = _paired(labels, found, [within, tier], tier)
        out = new if out is None else out.union(new)
    return out


def preferred_matches(labels: DataFrame, found: DataFrame, radius: float = NEAR) -> DataFrame:
    """``pair_id, label_id, found_id, tier``: labels and predictions of a pair, each used once, by handle, then by text, then by place.

    labels and found: ``pair_id``, an id (label_id, found_id: their order), ``handle, texts`` (array), ``x, y, category, status``. In each tier the labels left take, in order, the best prediction left: of their category if one is there, then of their status, then the nearest, then the
    first. A handle is equal, not empty; texts share a member, not empty; a place is at most ``radius`` away. Candidates come from equality and grid joins; the taking goes through them in order and holds the ids taken.
    """
    out = None
    l = labels.select("pair_id", F.col("label_id").cast("long").alias("old"), "handle", "texts", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("category").alias("c"), F.col("status").alias("s"))  # noqa: E741
    f = found.select("pair_id", F.col("found_id").cast("long").alias("new"), "handle", "texts", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("category").alias("fc"), F.col("status").alias("fs"))

    def edges(tier: str, l: DataFrame, f: DataFrame) -> DataFrame:  # noqa: E741
        if tier == "handle":
            met = l.where("handle <> ''").join(f.where("handle <> ''").drop("texts", "x", "y"), ["pair_id", "handle"])
        elif tier == "text":
            text = F.explode(F.array_distinct(F.filter("texts", lambda t: t != ""))).alias("text")
            met = l.select("pair_id", "old", "c", "s", text).join(f.select("pair_id", "new", "fc", "fs", text), ["pair_id", "text"]).dropDuplicates(["pair_id", "old", "new"])
        else:
            placed = "x is not null and y is not null"
            near = grid_join(l.where(placed).select("pair_id", "old", "c", "s", "x", "y"), f.where(placed).select("pair_id", "new", "fc", "fs", "x", "y"), radius, ["pair_id"])
            met = near.select("l.pair_id", "l.old", "l.c", "l.s", "r.new", "r.fc", "r.fs", "distance")
        off = F.when(F.col("c").eqNullSafe(F.col("fc")), 0).otherwise(1)
        odd = F.when(F.col("s").eqNullSafe(F.col("fs")), 0).otherwise(1)
        return met.select("pair_id", "old", "new", off.alias("off"), odd.alias("odd"), (F.col("distance") if tier == "spatial" else F.lit(0.0)).alias("far"))

    for tier in ("handle", "text", "spatial"):
        if out is not None:
            l = l.join(out.select("pair_id", F.col("label_id").alias("old")), ["pair_id", "old"], "left_anti")  # noqa: E741
            f = f.join(out.select("pair_id", F.col("found_id").alias("new")), ["pair_id", "new"], "left_anti")
        taken = fold(edges(tier, l, f), ["pair_id"], ["old", "off", "odd", "far", "new"], Assign, "label_id long, found_id long")
        taken = checkpointed(taken.withColumn("tier", F.lit(tier)))
        out = taken if out is None else out.union(taken)
    return out


def preferred_outcomes(labels: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """``pair_id, kind, id``: matched, missed and unresolvable labels; duplicate and spurious predictions.

    A label that is not ``resolved`` (names no entity) and not matched is unresolvable. A leftover prediction is a duplicate of a matched label of its pair and category that has its handle or one of its texts; nearness alone makes none.
    """
    keys = ["pair_id", "label_id"]
    told = labels.join(matches.select(*keys), keys, "left_semi")
    open_ = labels.join(matches.select(*keys), keys, "left_anti")
    rest = found.join(matches.select("pair_id", "found_id"), ["pair_id", "found_id"], "left_anti")
    by_handle = rest.where("handle <> ''").join(told.select("pair_id", "category", "handle").distinct(), ["pair_id", "category", "handle"], "left_semi")
    text = F.explode(F.filter("texts", lambda t: t != "")).alias("text")
    by_text = rest.select("pair_id", "found_id", "category", text).join(told.select("pair_id", "category", text).distinct(), ["pair_id", "category", "text"], "left_semi")
    again = by_handle.select("pair_id", "found_id").union(by_text.select("pair_id", "found_id")).distinct()
    spurious = rest.join(again, ["pair_id", "found_id"], "left_anti")
    row = lambda df, kind, id_: df.select("pair_id", F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"))
    return (
        row(matches, "matched", "label_id").union(row(open_.where("resolved"), "missed", "label_id")).union(row(open_.where("not resolved"), "unresolvable", "label_id"))
        .union(row(again, "duplicate", "found_id")).union(row(spurious, "spurious", "found_id"))
    )


def outcomes(labels: DataFrame, found: DataFrame, matches: DataFrame, within: str = "pair_id", resolved: str = "resolved") -> DataFrame:
    """``kind, id``: matched, missed and unresolvable labels; duplicate and spurious predictions.

    A leftover prediction is a duplicate where a matched label of its pair has its handle or text; a label that names no
    entity is unresolvable, and never missed.
    """
    open_labels = labels.join(matches, "label_id", "left_anti")
    told = labels.join(matches, "label_id", "left_semi")
    rest = found.join(matches, "found_id", "left_anti")
    again = None
    for key in ("handle", "text"):
        hit = rest.join(told.where(F.col(key) != "").select(within, key).distinct(), [within, key], "left_semi").select("found_id")
        again = hit if again is None else again.union(hit)
    again = again.distinct()
    parts = [
        (matches.select("label_id"), "matched"),
        (open_labels.where(resolved).select("label_id"), "missed"),
        (open_labels.where(~F.col(resolved)).select("label_id"), "unresolvable"),
        (again, "duplicate"),
        (rest.join(again, "found_id", "left_anti").select("found_id"), "spurious"),
    ]
    rows = None
    for df, kind in parts:
        df = df.toDF("id").select(F.lit(kind).alias("kind"), "id")
        rows = df if rows is None else rows.union(df)
    return rows


def recall_by(labels: DataFrame, by: str, hit: Column) -> DataFrame:
    """tp, fn and recall for each kind of labelled entity; labels without one are counted as ``<unresolved>``."""
    kind = F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("<unresolved>")).alias("kind")
    n = labels.groupBy(kind).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"))
    return n.withColumn("recall", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6))


def attribution(pairs: DataFrame, expected: str, given: str) -> DataFrame:
    """Of matched findings: how often each pair of categories occurs, and the share of agreement over all."""
    counts = pairs.groupBy(expected, given).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum(F.when(F.col(expected) == F.col(given), F.col("n")).otherwise(0)).alias("_ok"), F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).select(expected, given, "n", F.round(F.try_divide("_ok", "_all"), 6).alias("accuracy"))  # one row


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1: null where nothing was said or there was nothing to find; F1 is 0 where both are known and 0."""
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    return p, r, F.when(p.isNull() | r.isNull(), None).otherwise(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def first_relevant(hits: DataFrame, query: str, rank: str, relevant: Column, k: int) -> DataFrame:
    """For each query the rank of its first relevant hit (null: none), whether it is within k, and how many are."""
    return hits.groupBy(query).agg(
        F.min(F.when(relevant, F.col(rank))).alias("first_rank"),
        F.coalesce(F.bool_or(relevant & (F.col(rank) <= k)), F.lit(False)).alias("hit"),
        F.count_if(relevant & (F.col(rank) <= k)).alias("n_relevant"),
    )


def corpus_status(pairs: DataFrame, flags: dict[str, Column], complete: Column) -> DataFrame:
    """One row: how many pairs there are, how many meet each condition, and whether all are complete."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()],
        F.coalesce(F.bool_and(complete), F.lit(True)).alias("complete"),
    )


def folds(df: DataFrame, key: str, label: str, k: int = 3) -> DataFrame:
    """``df`` with fold: rows of each label dealt in turn, by hash of the key; no more folds than the rarest label has rows."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.least(F.min("n"), F.lit(k)).alias("_k"))
    turn = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)) - 1
    return df.withColumn("_turn", turn).join(F.broadcast(least)).withColumn("fold", (F.col("_turn") % F.col("_k")).cast("int")).drop("_turn", "_k")  # one row
