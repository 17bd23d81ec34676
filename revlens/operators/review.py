"""Reviews: sessions, listings, retraction, deletion, defaults, labels of markings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing(df: DataFrame, when: str, key: str, *conditions: Column | None) -> DataFrame:
    """Rows that meet the conditions given (None: no condition), newest first; the last key decides ties."""
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df.orderBy(F.desc(when), F.desc(key))


def retract(df: DataFrame, which: Column, column: str, now: Column) -> DataFrame:
    """Sets the retraction time of the rows named, once: those retracted before keep theirs. Nothing is deleted."""
    return df.withColumn(column, F.when(which & F.col(column).isNull(), now).otherwise(F.col(column)))


def set_default(df: DataFrame, key: str, chosen, flag: str, on: bool = True) -> DataFrame:
    """Makes a row the only default of all (``on``), or no default, which touches no other row. An unknown key changes nothing."""
    if not on:
        return df.withColumn(flag, F.when(F.col(key) == chosen, False).otherwise(F.col(flag)))
    known = df.where(F.col(key) == chosen).select(F.lit(True).alias("_known")).distinct()
    marked = df.join(F.broadcast(known), F.lit(True), "left")  # one row at most
    return marked.withColumn(flag, F.when(F.col("_known"), F.col(key) == chosen).otherwise(F.col(flag))).drop("_known")


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the last new row of each key in place of its own: replaced whole, never merged."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    own = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").select(*current.columns)
    return current.join(own, keys, "left_anti").select(*current.columns).union(own)


def reopen(sessions: DataFrame, key: str, chosen, group: str, status: str, amended: str) -> DataFrame:
    """Opens a submitted session again, counting the amendment, and closes the other open ones of its group."""
    own = sessions.where((F.col(key) == chosen) & (F.col(status) == "submitted")).select(F.col(group).alias("_group")).distinct()
    marked = sessions.join(F.broadcast(own), F.col(group) == F.col("_group"), "left")  # one row at most
    mine = F.col("_group").isNotNull() & (F.col(key) == chosen)
    rival = F.col("_group").isNotNull() & (F.col(key) != chosen) & (F.col(status) == "open")
    return marked.withColumn(amended, F.when(mine, F.col(amended) + 1).otherwise(F.col(amended))).withColumn(
        status, F.when(mine, "open").when(rival, "closed").otherwise(F.col(status))
    ).drop("_group")


def same_entity(a: dict[str, Column], b: dict[str, Column], within: float = 0.01) -> Column:
    """Whether two addresses name one entity: handles decide, and one with a handle is never one without; where neither has one, parent, type, layer, text and place do.

    Empty text and null are alike; a place agrees within ``within`` along each axis, an unknown one only with an unknown one.
    """

    def blank(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    ha, hb = blank(a["handle"]), blank(b["handle"])
    rest = F.lit(True)
    for name in ("parent", "type", "layer", "text"):
        rest &= blank(a[name]).eqNullSafe(blank(b[name]))
    near = F.coalesce((F.abs(a["x"] - b["x"]) <= within) & (F.abs(a["y"] - b["y"]) <= within), a["x"].isNull() & b["x"].isNull())
    return F.when(ha.isNotNull() | hb.isNotNull(), F.coalesce(ha == hb, F.lit(False))).otherwise(rest & near)


def finding_status(description: Column, severity: Column) -> Column:
    """Status from a ``[STATUS]`` at the head of a description; without one the severity."""
    return F.coalesce(F.nullif(F.regexp_extract(description, r"^\[([A-Z_]+)\]", 1), F.lit("")), severity)


def overlay(violations: DataFrame, key: str, places: Column, severity: str, colours: dict[str, str], default: str) -> DataFrame:
    """One row for each place of each violation, coloured by severity."""
    table = F.create_map(*[F.lit(v) for pair in colours.items() for v in pair])
    return violations.select(key, severity, F.explode(places).alias("place")).select(
        key, F.col("place")[0].alias("x"), F.col("place")[1].alias("y"), F.coalesce(F.try_element_at(table, F.col(severity)), F.lit(default)).alias("colour")
    )


def counts_text(df: DataFrame, group: str, category: str, noun: str) -> DataFrame:
    """A plain summary of each group: total and number for each category by name, singular or plural."""
    n = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))

    def said(k: Column) -> Column:
        return F.concat(k.cast("string"), F.lit(f" {noun}"), F.when(k == 1, "").otherwise("s"))

    parts = F.array_sort(F.collect_list(F.struct(F.col(category).alias("c"), F.col("n").alias("n"))))
    shown = F.array_join(F.transform(parts, lambda p: F.concat(p["c"], F.lit(": "), p["n"].cast("string"))), ", ")
    return n.groupBy(group).agg(F.concat(said(F.sum("n")), F.lit(" ("), shown, F.lit(")")).alias("summary"))


def shortfall(labels: DataFrame, verdicts: list[str], verdict: str, retracted: Column, least: int) -> DataFrame:
    """For each verdict the live and retracted labels, and how many are lacking of ``least``."""
    n = labels.groupBy(verdict).agg(F.count_if(~retracted).alias("live"), F.count_if(retracted).alias("retracted"))
    rows = labels.sparkSession.createDataFrame([(v,) for v in verdicts], f"{verdict} string")
    return rows.join(n, verdict, "left").select(
        verdict, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("live", "retracted")],
        F.greatest(F.lit(least) - F.coalesce("live", F.lit(0)), F.lit(0)).alias("lacking"),
    )


def new_issues(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Issues of the new side that the old one lacks; those on both sides are no news."""
    return new.select(*keys).distinct().join(old, keys, "left_anti")


def two_sided(new: DataFrame, old: DataFrame, key: str, old_wins: Column) -> DataFrame:
    """Rows of both sides by key: the new side's, but the old one's where that side alone was aligned (a condition on ``old``) or is alone."""
    first = old.where(old_wins)
    rest = new.join(first.select(key), key, "left_anti")
    lone = old.where(~F.coalesce(old_wins, F.lit(False))).join(new.select(key), key, "left_anti")
    return first.withColumn("side", F.lit("old")).unionByName(rest.withColumn("side", F.lit("new"))).unionByName(lone.withColumn("side", F.lit("old")))


def in_both(old: DataFrame, new: DataFrame, key: str, *values: str) -> DataFrame:
    """Full outer difference of fields by key: matched, changed, added or removed, each value on both sides."""
    a, b = old.alias("a"), new.alias("b")
    v = values[0]
    o, n = F.col(f"a.{v}"), F.col(f"b.{v}")
    status = F.when(o.isNull() & n.isNull(), "MATCHED").when(o.isNull(), "ADDED").when(n.isNull(), "REMOVED").when(o == n, "MATCHED").otherwise("CHANGED")
    return a.join(b, key, "full_outer").select(key, o.alias("old"), n.alias("new"), status.alias("status"))
