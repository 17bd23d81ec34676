"""Notes of a sheet, told by their words and by what stands beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .zones import ANCHORS, folded

# What marks a sentence as a note.
ENDINGS = ["こと", "ノコト", "事", "。"]
STRONG = ["注記", "注意"]
PREFIX = "注"
SPECS = ["施工", "硬度"]
LEAST_LENGTH, SLACK = 6, 3
X_PITCHES, ROW_SHARE, MOST_LENGTH, FALLBACK = 3.0, 0.3, 2, 0.02


def is_note_sentence(text: Column) -> Column:
    """Whether a text reads as a note: a note word or prefix, or six characters and more that end as an instruction (but for three more), name a treatment or hold an anchor of notes."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    said = folded(text)
    strong = F.startswith(raw, F.lit(PREFIX)) | said.rlike(r"(?U)\bnotes?\b")
    for token in STRONG:
        strong |= F.contains(raw, F.lit(token))
    long = F.lit(False)
    for token in ENDINGS:
        long |= F.contains(F.right(raw, F.lit(len(token) + SLACK)), F.lit(token))
    for token in SPECS:
        long |= F.contains(raw, F.lit(token))
    for anchor in ANCHORS["notes"]:
        long |= F.contains(said, F.lit(anchor))
    return F.coalesce((raw != "") & (strong | ((F.char_length(raw) >= LEAST_LENGTH) & long)), F.lit(False))


def row_pitch(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``sheet, pitch``: the upper median gap between a sheet's distinct rows (y to three places), else 2 in 100 of its span. By ranks, so no sheet is gathered."""
    rows = points.select("sheet", F.round("y", 3).alias("y")).distinct()
    gaps = rows.select("sheet", (F.col("y") - F.lag("y").over(Window.partitionBy("sheet").orderBy("y"))).alias("gap")).where("gap > 0")
    placed = gaps.withColumns({"place": F.row_number().over(Window.partitionBy("sheet").orderBy("gap")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("sheet"))})
    middle = placed.where(F.col("place") == F.floor(F.col("n") / 2)).select("sheet", F.col("gap").alias("pitch"))
    return spans.join(middle, "sheet", "left").select("sheet", F.coalesce("pitch", F.greatest(F.col("span") * FALLBACK, F.lit(1e-6))).alias("pitch"))


def notes(items: DataFrame, vetoed: Column, spans: DataFrame | None = None) -> DataFrame:
    """``items`` (sheet, ord, text, x, y) that are notes, with ``seed``: sentences that read as notes, and short texts beside one.

    ``vetoed``: whether a zone of higher rank owns an item; those are none. A text of one or two characters beside a sentence, in its row (three tenths of the row pitch up or down)
    and three pitches away at most, is a note too. Such texts make no others notes. spans: ``sheet, span``; without it, the width over the sheet's sentences, or 1. Sentences lie in
    cells of the reach of their sheet, and short texts look in the nine around: no pairs of a whole sheet are made. Items without a place are none.
    """
    rows = items.where((~F.coalesce(vetoed, F.lit(False))) & F.col("x").isNotNull() & F.col("y").isNotNull())
    seeds = rows.where(is_note_sentence(F.col("text")))
    extent = seeds.groupBy("sheet").agg((F.max("x") - F.min("x")).alias("wide"))
    if spans is not None:
        extent = extent.join(spans, "sheet", "left")
        wide = F.coalesce(F.nullif("span", F.lit(0.0)), F.nullif("wide", F.lit(0.0)), F.lit(1.0))
    else:
        wide = F.coalesce(F.nullif("wide", F.lit(0.0)), F.lit(1.0))
    pitch = row_pitch(seeds, extent.select("sheet", wide.alias("span"))).withColumnRenamed("pitch", "__pitch")
    reach_x, reach_y = F.col("__pitch") * X_PITCHES, F.col("__pitch") * ROW_SHARE
    short = rows.withColumn("__t", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")).where((F.char_length("__t") <= MOST_LENGTH) & (F.col("__t") != "")).drop("__t")
    short = short.where(~is_note_sentence(F.col("text")))
    cell = {"__cx": F.floor(F.col("x") / reach_x), "__cy": F.floor(F.col("y") / reach_y)}
    a = short.join(pitch, "sheet").withColumns(cell).alias("a")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    b = seeds.join(pitch, "sheet").withColumns(cell).select("sheet", "x", "y", "__cx", "__cy", around)
    b = b.select("sheet", "x", "y", (F.col("__cx") + F.col("s.i")).alias("__cx"), (F.col("__cy") + F.col("s.j")).alias("__cy")).alias("b")
    near = (
        (F.col("a.sheet") == F.col("b.sheet")) & (F.col("a.__cx") == F.col("b.__cx")) & (F.col("a.__cy") == F.col("b.__cy"))
        & (F.abs(F.col("a.x") - F.col("b.x")) <= F.col("a.__pitch") * X_PITCHES) & (F.abs(F.col("a.y") - F.col("b.y")) <= F.col("a.__pitch") * ROW_SHARE)
    )
    beside = a.join(b, near, "left_semi")
    return seeds.withColumn("seed", F.lit(True)).union(beside.select(*rows.columns).withColumn("seed", F.lit(False)))
