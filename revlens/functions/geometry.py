"""Plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def in_box(x: Column, y: Column, box: Box) -> Column:
    """Inclusive containment in (xmin, ymin, xmax, ymax)."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Ray casting with half-open edges; a literal polygon becomes one flat expression."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(points, points[-1:] + points[:-1], strict=True):
        if ay == by:
            continue
        spans = (F.lit(ay) > y) != (F.lit(by) > y)
        odd = odd != (spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return odd


def in_polygon_column(x: Column, y: Column, points: Column) -> Column:
    """As :func:`in_polygon` for an array<struct<x,y>> column; fewer than three points hold nothing."""
    before = F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))))

    def crossed(a: Column, b: Column) -> Column:
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    inside = F.aggregate(F.zip_with(points, before, crossed), F.lit(False), lambda acc, c: acc != c)
    return (F.size(points) >= 3) & F.coalesce(inside, F.lit(False))


def in_shape(x: Column, y: Column, box: Box, polygon: list[tuple[float, float]] | None = None) -> Column:
    """Box first, then the outline where there is one of three points or more."""
    inside = in_box(x, y, box)
    return inside & in_polygon(x, y, polygon) if polygon and len(polygon) >= 3 else inside


def in_any_shape(x: Column, y: Column, shapes: list[tuple[Box, list[tuple[float, float]] | None]]) -> Column:
    found = F.lit(False)
    for box, polygon in shapes:
        found |= in_shape(x, y, box, polygon)
    return found


def unit(value: Column, low: float | Column, high: float | Column) -> Column:
    """Position between two bounds; null where they coincide."""
    return F.try_divide(value - low, F.lit(high) - low if not isinstance(high, Column) else high - low)


def from_fractions(fx: Column, fy: Column, bounds: Box) -> tuple[Column, Column]:
    """Sheet fractions (y down, clamped to [-0.5, 1.5]) to drawing coordinates (y up)."""
    fx, fy = (F.least(F.greatest(f, F.lit(-0.5)), F.lit(1.5)) for f in (fx, fy))
    return bounds[0] + fx * (bounds[2] - bounds[0]), bounds[3] - fy * (bounds[3] - bounds[1])


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; of a point from a point where the ends coincide."""
    dx, dy = bx - ax, by - ay
    along = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def path_distance(px: Column, py: Column, points: Column) -> Column:
    """Distance of a point from an open path, an array<struct<x,y>>; null for an empty path."""
    parts = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(1))), F.slice(points, 2, F.size(points)), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))
    return F.array_min(
        F.transform(parts, lambda s: segment_distance(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    )


def sheet_signature(width: Column, height: Column) -> Column:
    """Width by height to three places; null without a height."""
    return F.format_string("aspect-%.3f", F.try_divide(width, height))


def clamp_to_cap(low: Column, high: Column, cap: float) -> tuple[Column, Column]:
    """Shrinks an interval about its middle so that it is no longer than ``cap``."""
    over = F.greatest((high - low - cap) / 2, F.lit(0.0))
    return low + over, high - over
