"""State as append-only events: latest state, supersession, sync, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest values of each key, by one aggregate without a sort."""
    newest = events.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s"))
    return newest.select(*keys, *[f"s.{c}" for c in columns])


def superseded(events: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """``events`` with the id of the next row of the same key; null for the live one."""
    w = Window.partitionBy(*keys).orderBy(*order, id_col)
    return events.withColumn("superseded_by", F.lead(id_col).over(w))


def lww_sync(a: DataFrame, b: DataFrame, key: str, version: str) -> DataFrame:
    """What a two-way sync must do for each key: copy the newer (or the only) row over; equal versions need nothing."""
    x = a.select(F.col(key), F.col(version).alias("va"))
    y = b.select(F.col(key), F.col(version).alias("vb"))
    both = x.join(y, key, "full_outer")
    to_b = F.col("vb").isNull() | (F.col("va") > F.col("vb"))
    to_a = F.col("va").isNull() | (F.col("vb") > F.col("va"))
    return both.withColumn("action", F.when(to_b, "a_to_b").when(to_a, "b_to_a").otherwise("none"))


def cascade(parent: DataFrame, gone: Column, key: str, children: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Rows of each level to delete with the parents for which ``gone`` holds; children are (table, foreign key, key)."""
    out = [parent.where(gone)]
    above, name = out[0], key
    for child, foreign, own in children:
        above = child.join(above.select(F.col(name).alias(foreign)).distinct(), foreign, "left_semi")
        out.append(above)
        name = own
    return out


def resolve_default(rows: DataFrame, templates: DataFrame, signature: str, name: str) -> DataFrame:
    """The template of each row's signature, else the default one, else none."""
    own = templates.where(F.col(signature).isNotNull()).select(signature, F.col(name).alias("_own"))
    default = templates.where("is_default").agg(F.min(name).alias("_default"))
    return rows.join(own, signature, "left").join(F.broadcast(default)).select(  # one row
        *rows.columns, F.coalesce("_own", "_default").alias(name)
    )


def insert_absent(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys are not there yet, once each."""
    return wanted.dropDuplicates(keys).join(current, keys, "left_anti")


def override_merge(detected: DataFrame, template: DataFrame, zone: str, grow: str) -> DataFrame:
    """Detected boxes (zone, x0, y0, x1, y1) overlaid by a template's; the zone named ``grow`` may only grow."""
    d, t = detected.alias("d"), template.alias("t")
    both = d.join(t, zone, "full_outer")
    grown = F.col(zone) == grow

    def side(c: str, wider) -> Column:
        own, other = F.col(f"t.{c}"), F.col(f"d.{c}")
        return F.when(grown & own.isNotNull() & other.isNotNull(), wider(own, other)).otherwise(F.coalesce(own, other)).alias(c)

    source = F.when(F.col("t.x0").isNull(), "detected").when(F.col("d.x0").isNull(), "template").otherwise("both")
    return both.select(zone, *[side(c, F.least) for c in ("x0", "y0")], *[side(c, F.greatest) for c in ("x1", "y1")], source.alias("source"))


def coverage_check(cited: DataFrame, supplied: DataFrame, key: str) -> DataFrame:
    """All ways in which citations and supplies don't agree: cited but not supplied, and supplied but not cited."""
    a = cited.select(key).distinct().join(supplied, key, "left_anti").withColumn("problem", F.lit("not supplied"))
    b = supplied.select(key).distinct().join(cited, key, "left_anti").withColumn("problem", F.lit("not cited"))
    return a.unionByName(b)
