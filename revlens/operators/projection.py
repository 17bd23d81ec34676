"""Model space to paper space and back, for whole records at once: what is a point follows from a column's type."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructType

VIEW = ["paper_x", "paper_y", "paper_w", "paper_h", "anchor_x", "anchor_y", "view_h", "scale"]


def shows_model(view: Column, x: Column, y: Column) -> Column:
    """Whether a point of model space is within a view's window; a view without a scale shows no width."""
    half_w = F.coalesce(F.try_divide(view["paper_w"], view["scale"]) * 0.5, F.lit(0.0))
    half_h = view["view_h"] * 0.5
    return x.between(view["anchor_x"] - half_w, view["anchor_x"] + half_w) & y.between(view["anchor_y"] - half_h, view["anchor_y"] + half_h)


def shows_paper(view: Column, x: Column, y: Column) -> Column:
    return x.between(view["paper_x"] - view["paper_w"] * 0.5, view["paper_x"] + view["paper_w"] * 0.5) & y.between(view["paper_y"] - view["paper_h"] * 0.5, view["paper_y"] + view["paper_h"] * 0.5)


def to_paper(view: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return view["paper_x"] + (x - view["anchor_x"]) * view["scale"], view["paper_y"] + (y - view["anchor_y"]) * view["scale"]


def to_model(view: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of :func:`to_paper`; of a view without a scale the point itself."""
    flat = view["scale"] == 0
    back = lambda v, paper, anchor: F.when(flat, v).otherwise(view[anchor] + F.try_divide(v - view[paper], view["scale"]))
    return back(x, "paper_x", "anchor_x"), back(y, "paper_y", "anchor_y")


def _is_point(kind: DataType) -> bool:
    """A struct whose first two fields are numbers named x and y."""
    return isinstance(kind, StructType) and [f.name for f in kind][:2] == ["x", "y"] and all(isinstance(f.dataType, NumericType) for f in kind[:2])


def _depth(kind: DataType) -> int | None:
    """0 for a point, 1 for a list of points, 2 for a list of such lists; None for anything else."""
    depth = 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    return depth if _is_point(kind) and depth <= 2 else None


def _each(value: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """``f`` of every point of a value nested ``depth`` deep; a point without both coordinates stays."""
    if depth:
        return F.transform(value, lambda v: _each(v, depth - 1, f))
    return F.when(value["x"].isNotNull() & value["y"].isNotNull(), f(value)).otherwise(value)


def _first_point(schema: StructType, geometry: str, vectors: Sequence[str]) -> Column:
    """The first whole point: of the points in the order of their fields, then of the lists, then of the groups."""
    found = []
    for wanted in (0, 1, 2):
        for field in schema:
            if field.name in vectors or _depth(field.dataType) != wanted:
                continue
            value = F.col(f"{geometry}.{field.name}")
            points = F.array(value) if wanted == 0 else value if wanted == 1 else F.flatten(F.filter(value, lambda g: g.isNotNull()))
            whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
            first = F.get(whole, F.lit(0))
            found.append(F.when(first.isNotNull(), F.struct(first["x"].cast("double").alias("x"), first["y"].cast("double").alias("y"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<x:double,y:double>")


def project_records(
    records: DataFrame, views: DataFrame, by: str, geometry: str = "geometry", lengths: Sequence[str] = (), vectors: Sequence[str] = ()
) -> DataFrame:
    """``records`` with the struct column ``geometry`` in paper space, and ``view_index, view_scale, outside``.

    The struct's own type says what moves: structs that begin with x and y, lists of them and lists of such lists, in whatever fields they stand. Fields named in ``vectors`` are scaled and not moved, numbers named in ``lengths`` are scaled; all others stay as they are,
    as do further fields of a point (z). views: ``by, index`` and the columns of VIEW, a sheet's few windows. A record goes through one window as a whole, the first that shows its first point, else the sheet's first with ``outside`` true, so that nothing is torn at a
    window's edge. Sheets without windows, and records without a point, stay in model space (index -1, scale 1). Nulls anywhere stay nulls. Columns of the three new names are replaced.
    """
    schema = records.schema[geometry].dataType
    window = F.struct("index", *[F.col(c).cast("double").alias(c) for c in VIEW])
    sheets = views.groupBy(F.col(by).alias("__by")).agg(F.sort_array(F.collect_list(window)).alias("__views"))  # a layout's windows: tens at most
    rows = records.drop("view_index", "view_scale", "outside").withColumn("__at", _first_point(schema, geometry, vectors))
    rows = rows.join(sheets, F.col(by) == F.col("__by"), "left").drop("__by")
    at = F.col("__at")
    shown = F.get(F.filter("__views", lambda v: shows_model(v, at["x"], at["y"])), F.lit(0))
    rows = rows.withColumn("__shown", shown)
    rows = rows.withColumn("__view", F.when(at.isNotNull(), F.coalesce("__shown", F.get("__views", F.lit(0)))))
    view = F.col("__view")

    def moved(p: Column, kind: DataType) -> Column:
        x, y = to_paper(view, p["x"], p["y"])
        return F.struct(x.cast(kind["x"].dataType).alias("x"), y.cast(kind["y"].dataType).alias("y"), *[p[f.name].alias(f.name) for f in kind[2:]])

    def scaled(p: Column, kind: DataType) -> Column:
        return F.struct(*[(p[f.name] * view["scale"]).cast(f.dataType).alias(f.name) if isinstance(f.dataType, NumericType) else p[f.name].alias(f.name) for f in kind])

    def inner(kind: DataType) -> DataType:
        while isinstance(kind, ArrayType):
            kind = kind.elementType
        return kind

    out = []
    for field in schema:
        value, depth = F.col(f"{geometry}.{field.name}"), _depth(field.dataType)
        if depth is not None:
            change = scaled if field.name in vectors else moved
            value = _each(value, depth, lambda p, kind=inner(field.dataType), change=change: change(p, kind))
        elif field.name in lengths and isinstance(field.dataType, NumericType):
            value = (value * view["scale"]).cast(field.dataType)
        out.append(value.alias(field.name))
    held = F.col(geometry)
    return rows.withColumns(
        {
            geometry: F.when(view.isNull() | held.isNull(), held).otherwise(F.struct(*out)),
            "view_index": F.coalesce(view["index"], F.lit(-1)),
            "view_scale": F.coalesce(view["scale"], F.lit(1.0)),
            "outside": view.isNotNull() & F.col("__shown").isNull(),
        }
    ).drop("__at", "__views", "__shown", "__view")


def unproject_points(points: DataFrame, views: DataFrame, by: str, x: str = "x", y: str = "y", index: str | None = None) -> DataFrame:
    """``points`` of paper space with ``model_x, model_y, view_index``: through the window named by ``index`` (a column), else the first that holds the point; on the sheet itself (-1, unchanged) where none does."""
    window = F.struct("index", *[F.col(c).cast("double").alias(c) for c in VIEW])
    sheets = views.groupBy(F.col(by).alias("__by")).agg(F.sort_array(F.collect_list(window)).alias("__views"))
    rows = points.join(sheets, F.col(by) == F.col("__by"), "left").drop("__by")
    own = F.get(F.filter("__views", lambda v: v["index"] == F.col(index)), F.lit(0)) if index else F.lit(None)
    holds = F.get(F.filter("__views", lambda v: shows_paper(v, F.col(x), F.col(y))), F.lit(0))
    rows = rows.withColumn("__view", F.coalesce(own, holds))
    mx, my = to_model(F.col("__view"), F.col(x), F.col(y))
    there = F.col("__view").isNotNull()
    return rows.withColumns({"model_x": F.when(there, mx).otherwise(F.col(x)), "model_y": F.when(there, my).otherwise(F.col(y)), "view_index": F.coalesce("__view.index", F.lit(-1))}).drop("__views", "__view")
