"""Placed blocks, exploded into what they draw: nested definitions with composed transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import checkpointed

MOST_DEPTH = 10  # a placement at depth 10 is still exploded, what it places in turn is not
MATRIX = ["a", "b", "c", "d", "e", "f"]  # x' = a x + b y + c; y' = d x + e y + f
PLACED = ["at_x", "at_y", "turn", "scale_x", "scale_y"]


def placement(x: Column, y: Column, turn: Column, scale_x: Column, scale_y: Column) -> Column:
    """The transform of a placement: scaled, turned by degrees, moved; nulls are no scaling, turn or move."""
    sx, sy = F.coalesce(scale_x, F.lit(1.0)), F.coalesce(scale_y, F.lit(1.0))
    angle = F.radians(F.coalesce(turn, F.lit(0.0)))
    cos, sin = F.cos(angle), F.sin(angle)
    zero = F.lit(0.0)
    parts = [cos * sx, -sin * sy, F.coalesce(x, zero), sin * sx, cos * sy, F.coalesce(y, zero)]
    return F.struct(*[p.cast("double").alias(n) for p, n in zip(parts, MATRIX, strict=True)])


def composed(outer: Column, inner: Column) -> Column:
    """First ``inner``, then ``outer``."""

    def row(p: str, q: str, r: str) -> list[Column]:
        return [
            outer[p] * inner["a"] + outer[q] * inner["d"],
            outer[p] * inner["b"] + outer[q] * inner["e"],
            outer[p] * inner["c"] + outer[q] * inner["f"] + outer[r],
        ]

    return F.struct(*[v.alias(n) for v, n in zip([*row("a", "b", "c"), *row("d", "e", "f")], MATRIX, strict=True)])


def moved(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["b"] * y + m["c"], m["d"] * x + m["e"] * y + m["f"]


def _holders(definitions: DataFrame, most_depth: int, nested: bool, only: DataFrame | None, paths: bool) -> DataFrame:
    """``block, path, depth, child, m, scale``: for each block (of ``only``, if given) every block that it holds, itself first, with the way to it; path is null without ``paths``."""
    inserts = definitions.where("kind = 'insert' and child is not null").select(
        F.col("block").alias("d_block"), F.col("ord").cast("long").alias("d_ord"), F.col("child").alias("d_child"),
        placement(*[F.col(c) for c in PLACED]).alias("step"), F.coalesce("scale_x", F.lit(1.0)).cast("double").alias("width"),
    )
    blocks = definitions.select("block").distinct()
    if only is not None:
        blocks = blocks.join(only.select("block").distinct(), "block", "left_semi")
    none = F.lit(None).cast("struct<" + ",".join(f"{n}:double" for n in MATRIX) + ">")
    no_path = F.array().cast("array<bigint>") if paths else F.lit(None).cast("array<bigint>")
    level = blocks.select("block", no_path.alias("path"), F.lit(0).alias("depth"), F.col("block").alias("child"), none.alias("m"), F.lit(1.0).alias("scale"))
    out = level
    for depth in range(1, most_depth + 1):
        through = F.when(F.col("m").isNull(), F.col("step")).otherwise(composed(F.col("m"), F.col("step")) if nested else F.col("step"))
        level = level.join(inserts, F.col("child") == F.col("d_block")).select(
            "block", F.concat("path", F.array("d_ord")).alias("path"), F.lit(depth).alias("depth"), F.col("d_child").alias("child"),
            through.alias("m"), (F.col("scale") * F.col("width") if nested else F.col("width")).alias("scale"),
        )
        level = checkpointed(level)
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def flattened(definitions: DataFrame, most_depth: int = MOST_DEPTH, nested: bool = True, only: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """``block, path, depth, kind, x1, y1, x2, y2, r, text, m, scale``: what each block draws in the end, in its own coordinates.

    definitions: ``block, ord, kind, child, x1, y1, x2, y2, r, text`` and the columns of PLACED, which count for the kind ``insert`` alone. m is the transform of
    the placements between the block and the drawn thing (null: drawn by the block itself), scale the product of their scale_x, depth their number, path the ords from the block
    down (null without ``paths``). Placements are joined level by level, and what the blocks draw at the end: placements of a known block go on, those of an unknown one end. A block is taken apart once,
    however often it is placed, and only if it is one of ``only`` (a column ``block``), where that is given; a definition that holds itself ends at ``most_depth``. With ``nested`` false only the innermost transform counts.
    """
    drawn = ["kind", "x1", "y1", "x2", "y2", "r", "text"]
    own = definitions.where("kind <> 'insert'").select(F.col("block").alias("d_block"), F.col("ord").cast("long").alias("d_ord"), *drawn)
    return _holders(definitions, most_depth, nested, only, paths).join(own, F.col("child") == F.col("d_block")).select(
        "block", F.concat("path", F.array("d_ord")).alias("path"), "depth", *drawn, "m", "scale"
    )


def exploded(placements: DataFrame, definitions: DataFrame, id_col: str, most_depth: int = MOST_DEPTH, nested: bool = True) -> DataFrame:
    """``id_col, path, kind, x1, y1, x2, y2, r, text``: what each placement (``id_col, block`` and the columns of PLACED) draws.

    Both ends of a line and the centre of a circle are moved and the radius takes scale_x; other kinds stay where their block has them. Things
    without a geometry (x1 null) draw nothing, as do placements of unknown or null blocks. See :func:`flattened`; ``nested`` false gives what a program draws that
    applies each thing's innermost placement alone.
    """
    return _drawn(placements, flattened(definitions.where("kind = 'insert' or x1 is not null"), most_depth, nested, placements.select("block")), id_col, nested).drop("depth")


def _drawn(placements: DataFrame, flat: DataFrame, id_col: str, nested: bool) -> DataFrame:
    top = placements.select(F.col(id_col), F.col("block").alias("__block"), placement(*[F.col(c) for c in PLACED]).alias("outer"), F.coalesce("scale_x", F.lit(1.0)).alias("width"))
    m = F.when(F.col("m").isNull(), F.col("outer")).otherwise(composed(F.col("outer"), F.col("m")) if nested else F.col("m"))
    scale = F.col("width") * F.col("scale") if nested else F.when(F.col("m").isNull(), F.col("width")).otherwise(F.col("scale"))
    rows = top.join(flat, F.col("__block") == F.col("block")).withColumns({"m": m, "scale": scale})
    line, circle = F.col("kind") == "line", F.col("kind") == "circle"
    (x1, y1), (x2, y2) = moved(F.col("m"), F.col("x1"), F.col("y1")), moved(F.col("m"), F.col("x2"), F.col("y2"))
    return rows.select(
        id_col, "path", "depth", "kind",
        *[F.when(line | circle, v).otherwise(F.col(n)).alias(n) for n, v in (("x1", x1), ("y1", y1))],
        *[F.when(line, v).otherwise(F.col(n)).alias(n) for n, v in (("x2", x2), ("y2", y2))],
        F.when(circle, F.coalesce("r", F.lit(1.0)) * F.col("scale")).otherwise(F.col("r")).alias("r"),
        "text",
    )


def extents(placements: DataFrame, definitions: DataFrame, id_col: str, most_depth: int = MOST_DEPTH, nested: bool = True) -> DataFrame:
    """``id_col, kind, n, deepest, xmin, xmax, ymin, ymax, reach, r``: of all that :func:`exploded` gives for a placement, by kind, the number, the deepest way, the least and greatest x1 and y1, and the greatest x2 and r.

    Placements of one block, turn and scale differ by a move alone, and a move takes a least value along with it. So each such form is drawn once, however many placements have it, and placements only
    take up their form's few rows. Forms come to the placements by broadcast: there must be few of them (tens of thousands) against the placements.
    """
    form = ["block", "turn", "scale_x", "scale_y"]
    zero = F.lit(0.0)
    plain = [F.col("block"), *[F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) for c, v in zip(form[1:], (0.0, 1.0, 1.0), strict=True)]]
    places = placements.select(id_col, *plain, *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("at_x", "at_y")])
    forms = checkpointed(placements.select(*plain).distinct()).select(F.struct(*form).alias("form"), *form, zero.alias("at_x"), zero.alias("at_y"))
    flat = flattened(definitions.where("kind = 'insert' or x1 is not null"), most_depth, nested, forms, paths=False)
    moves = F.col("kind").isin("line", "circle")
    drawn = _drawn(forms, flat, "form", nested).withColumn("moves", moves if nested else moves & (F.col("depth") == 0))
    ends = (("xmin", F.min, "x1"), ("xmax", F.max, "x1"), ("ymin", F.min, "y1"), ("ymax", F.max, "y1"), ("reach", F.max, "x2"), ("r", F.max, "r"))
    small = drawn.groupBy("form", "kind", "moves").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"), *[f(c).alias(n) for n, f, c in ends]).select("form.*", "kind", "moves", "n", "deepest", *[n for n, _, _ in ends])
    small = checkpointed(small)
    met = places.repartition(id_col).join(F.broadcast(small), form)
    x, y = (F.when(F.col("moves"), F.col(c)).otherwise(zero) for c in ("at_x", "at_y"))
    shift = {"xmin": x, "xmax": x, "ymin": y, "ymax": y, "reach": F.when(F.col("kind") == "line", x).otherwise(zero), "r": zero}
    return met.groupBy(id_col, "kind").agg(F.sum("n").alias("n"), F.max("deepest").alias("deepest"), *[f(F.col(n) + shift[n]).alias(n) for n, f, _ in ends])
