"""Filters and projections over entity-like tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_query(
    df: DataFrame,
    type_col: str,
    text_col: str,
    types: list[str] | None = None,
    contains: str | None = None,
    pattern: str | None = None,
    text_only: bool = False,
) -> DataFrame:
    """All of the given conditions together. Containment ignores case; a pattern that doesn't compile is ignored."""
    if types is not None:
        df = df.where(F.col(type_col).isin(types))
    if contains:
        df = df.where(F.contains(F.lower(text_col), F.lit(contains.lower())))
    if pattern is not None:
        try:
            re.compile(pattern)
        except re.error:
            pattern = None
    if pattern is not None:
        df = df.where(F.col(text_col).rlike(pattern))
    if text_only:
        df = df.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "")
    return df


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; order must be total within a key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; order must be total within a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def preview(text: Column, most: int = 80) -> Column:
    """A text on one line, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def manifest(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by id, with the text cut short, and how many text-bearing rows there are beyond them."""
    bearing = df.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "")
    total = bearing.agg(F.count(F.lit(1)).alias("n"))
    top = bearing.orderBy(id_col).limit(limit).select(id_col, preview(F.col(text_col)).alias("preview"))
    return top.join(F.broadcast(total)).select(  # one row
        id_col, "preview", F.greatest(F.col("n") - limit, F.lit(0)).alias("omitted")
    )


def pool(
    df: DataFrame,
    inside: Column,
    margin: Column,
    excluded: Column,
    value_col: str,
    values: DataFrame,
    rules: DataFrame,
) -> DataFrame:
    """Rows in a zone but not in the margin or an excluded shape, whose value is neither structural nor dismissed.

    ``values`` and ``rules`` hold values to leave out, in a column of the same name; null values are kept.
    """
    kept = df.where(inside & ~margin & ~excluded)
    return kept.join(values, value_col, "left_anti").join(rules, value_col, "left_anti")


def with_fallback(df: DataFrame, strict: Column, loose: Column) -> DataFrame:
    """Rows that pass ``strict``; where none does, those that pass ``loose``."""
    any_ = df.agg(F.coalesce(F.bool_or(strict), F.lit(False)).alias("_any"))
    kept = df.join(F.broadcast(any_)).where(F.when(F.col("_any"), strict).otherwise(loose))  # one row
    return kept.drop("_any")


def structured_values(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """The distinct trimmed values of several columns that have ``least`` characters or more."""
    values = df.select(F.explode(F.array(*[F.trim(F.col(c)) for c in columns])).alias("value"))
    return values.where(F.length("value") >= least).distinct()


def owner(x: Column, y: Column, zones: list[tuple[str, int, Column]]) -> Column:
    """The zone of the least rank whose shape holds a point; zones are (name, rank, condition), ties by name."""
    out = F.lit(None).cast("string")
    for name, _, holds in sorted(zones, key=lambda z: (z[1], z[0]), reverse=True):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def owned_by_other(owner_name: Column, ranks: dict[str, int], zone: str) -> Column:
    """Whether the owner outranks ``zone``; peers don't."""
    rank = F.create_map(*[F.lit(v) for pair in ranks.items() for v in pair])
    return F.coalesce(rank[owner_name] < ranks[zone], F.lit(False))


def mine(df: DataFrame, owner_col: str, user) -> DataFrame:
    """Rows that a user owns and those nobody owns."""
    return df.where((F.col(owner_col) == user) | F.col(owner_col).isNull())


def live(df: DataFrame, deleted: Column) -> DataFrame:
    """Rows not marked as deleted; an unset mark counts as not deleted."""
    return df.where(~F.coalesce(deleted, F.lit(False)))


def keyword_search(df: DataFrame, text_col: str, keywords: list[str], scope: Column | None = None) -> DataFrame:
    """Rows whose text has any keyword, case aside; keywords are plain text, not patterns."""
    pattern = "(?i)" + "|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in keywords)
    found = df.where(F.col(text_col).rlike(pattern)) if keywords else df.where(F.lit(False))
    return found if scope is None else found.where(scope)


def keywords(parts: Column, least: int, most: int = 20) -> Column:
    """Distinct lower-case words of at least ``least`` characters, in order, ``most`` at most."""
    words = F.filter(F.split(F.lower(parts), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least)
    return F.slice(F.array_distinct(words), 1, most)


def dismissed(df: DataFrame, text_col: str, rules: DataFrame) -> DataFrame:
    """``df`` with ``dismissed``: the folded text equals a rule or begins with a prefix rule; never a mere part of it.

    ``rules`` has key (folded text) and prefix (boolean). Prefix rules are compared by their first four characters
    first, so the join is on equality; shorter ones don't count as prefixes.
    """
    folded = F.lower(F.trim(F.regexp_replace(F.col(text_col), r"\s+", " ")))
    whole = rules.where(~F.col("prefix")).select(F.col("key").alias("_whole")).distinct()
    heads = rules.where(F.col("prefix") & (F.length("key") >= 4))
    heads = heads.select(F.col("key").alias("_head"), F.substring("key", 1, 4).alias("_front")).distinct()
    keyed = df.withColumns({"_key": folded, "_start": F.substring(folded, 1, 4)})
    hits = (
        keyed.select("_key", "_start").distinct()
        .join(heads, F.col("_start") == F.col("_front"))
        .where(F.col("_key").startswith(F.col("_head")))
        .select("_key")
        .union(keyed.select("_key").join(whole, F.col("_key") == F.col("_whole"), "left_semi"))
        .distinct()
        .withColumn("dismissed", F.lit(True))
    )
    return keyed.join(hits, "_key", "left").withColumn("dismissed", F.coalesce("dismissed", F.lit(False))).drop("_key", "_start")
