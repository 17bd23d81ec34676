"""Rule checks that give violation rows (rule, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sheet_rules import PLACEHOLDERS, SCALES


def violations(df: DataFrame, rule: str, when: Column, subject: Column, detail: Column) -> DataFrame:
    """A row for every row for which a condition holds; an unknown condition doesn't."""
    return df.where(when).select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def once_per(df: DataFrame, rule: str, when: Column, key: str) -> DataFrame:
    """One row for each distinct key for which a condition holds, with the number of rows."""
    return df.where(when).groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(rule).alias("rule"), F.col(key).cast("string").alias("subject"), F.col("n").cast("string").alias("detail")
    )


def duplicates(df: DataFrame, rule: str, keys: list[str], order: str, most: int) -> DataFrame:
    """Second and later rows of equal keys; a report of the first ``most`` by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    later = df.withColumn("_n", F.row_number().over(w)).where("_n > 1")
    return later.orderBy(order).limit(most).select(
        F.lit(rule).alias("rule"), F.col(order).cast("string").alias("subject"), F.col("_n").cast("string").alias("detail")
    )


def unbalanced(df: DataFrame, rule: str, by: str, many: Column, few: Column, most: int, least: int) -> DataFrame:
    """Groups with over ``most`` rows of one sort and under ``least`` of another."""
    n = df.groupBy(by).agg(F.count_if(many).alias("a"), F.count_if(few).alias("b"))
    return n.where((F.col("a") > most) & (F.col("b") < least)).select(
        F.lit(rule).alias("rule"), F.col(by).cast("string").alias("subject"), F.concat_ws("/", "a", "b").alias("detail")
    )


def missing_in(groups: DataFrame, df: DataFrame, rule: str, by: str, present: Column) -> DataFrame:
    """Groups without any row for which ``present`` holds."""
    return groups.select(by).distinct().join(df.where(present), by, "left_anti").select(
        F.lit(rule).alias("rule"), F.col(by).cast("string").alias("subject"), F.lit("missing").alias("detail")
    )


def present_without(df: DataFrame, rule: str, by: str, present: Column, other: Column) -> DataFrame:
    """Groups that have one thing, but not the other that it calls for."""
    flags = df.groupBy(by).agg(F.count_if(present).alias("a"), F.count_if(other).alias("b"))
    return flags.where("a > 0 and b = 0").select(
        F.lit(rule).alias("rule"), F.col(by).cast("string").alias("subject"), F.col("a").cast("string").alias("detail")
    )


def required_fields(df: DataFrame, rule: str, by: str, field: str, wanted: list[str]) -> DataFrame:
    """One row for each group that lacks some wanted field, naming those, in order."""
    held = df.groupBy(by).agg(F.collect_set(F.when(F.col(field).isin(wanted), F.col(field))).alias("held"))
    lacking = F.array_except(F.array_sort(F.array(*[F.lit(w) for w in wanted])), "held")
    return held.where(F.size(lacking) > 0).select(
        F.lit(rule).alias("rule"), F.col(by).cast("string").alias("subject"), F.array_join(lacking, ",").alias("detail")
    )


def off_standard(df: DataFrame, rule: str, value: Column, allowed: list[float], tolerance: float, subject: Column, by: str, order: str, most: int) -> DataFrame:
    """Values not within ``tolerance`` of any allowed one: a report of the first ``most`` of each group."""
    fits = F.exists(F.array(*[F.lit(a) for a in allowed]), lambda a: F.abs(a - value) < tolerance)
    w = Window.partitionBy(by).orderBy(order)
    found = df.where(value.isNotNull() & ~fits).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return found.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), value.cast("string").alias("detail"))


def run_rules(rules: list[DataFrame]) -> DataFrame:
    """All rules' rows, with the place of each rule."""
    return reduce(
        lambda a, b: a.unionByName(b), [r.withColumn("place", F.lit(i)) for i, r in enumerate(rules, 1)]
    )


def off_scale(df: DataFrame, rule: str, text: Column, subject: Column, scales: list[str] = SCALES) -> DataFrame:
    """Texts that state a scale which is not one of the standard's."""
    said = F.replace(F.regexp_replace(F.regexp_extract(text, r"(?i)scale\s*:?\s*(\d+\s*[:/]\s*\d+)", 1), r"\s+", ""), F.lit("/"), F.lit(":"))
    return violations(df, rule, (said != "") & ~said.isin(scales), subject, said)


def off_measure(df: DataFrame, rule: str, stated: Column, measured: Column, scale: Column, by: str, order: str, most: int = 2, share: float = 0.05) -> DataFrame:
    """Stated measures (above zero) more than ``share`` off the measured one times the scale, and not that rounded, halves to even; the first ``most`` of each group by order."""
    expected = measured * scale
    wrong = df.where((stated > 0) & (expected > 0) & ~(stated / expected).between(1 - share, 1 + share) & (stated != F.rint(expected)))
    first = wrong.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= most)
    return first.select(F.lit(rule).alias("rule"), F.col(order).cast("string").alias("subject"), F.round(stated, 3).cast("string").alias("detail"))


def placeholders(df: DataFrame, rule: str, text: Column, where: Column, subject: Column) -> DataFrame:
    """Texts that are empty or hold a placeholder, in any case, where a text is wanted."""
    said = F.coalesce(F.trim(text), F.lit(""))
    held = said == ""
    for word in PLACEHOLDERS:
        held |= F.contains(F.lower(said), F.lit(word))
    return violations(df, rule, where & held, subject, F.coalesce(text, F.lit("")))


def empty_attributes(df: DataFrame, rule: str, attributes: Column, subject: Column) -> DataFrame:
    """One row for each attribute (of a map) that is there and blank, named; null ones aren't there."""
    held = df.select(subject.cast("string").alias("subject"), F.explode(F.map_entries(attributes)).alias("a"))
    return held.where(F.col("a.value").isNotNull() & (F.trim("a.value") == "")).select(F.lit(rule).alias("rule"), "subject", F.col("a.key").alias("detail"))


def too_short_for(df: DataFrame, rule: str, text: Column, pattern: str, most: int, subject: Column) -> DataFrame:
    """Texts that hold a pattern and little else: at most ``most`` characters."""
    return violations(df, rule, text.rlike(pattern) & (F.length(F.trim(text)) <= most), subject, F.trim(text))
