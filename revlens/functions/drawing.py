"""Scalars of drawings: places, margins, anchors, line attributes, revisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Box, in_box

# Line weights that stand for another's, and the default's millimetres.
BY_LAYER, BY_BLOCK, BY_DEFAULT = -1, -2, -3
DEFAULT_MM = 0.25
# The first colours of the drawing index.
INDEX_COLOURS = {1: "#ff0000", 2: "#ffff00", 3: "#00ff00", 4: "#00ffff", 5: "#0000ff", 6: "#ff00ff", 7: "#ffffff", 8: "#808080", 9: "#c0c0c0"}
# Labels of a sheet's margin grid.
GRID_LABEL = r"^([A-H]|0*[1-9]|0*1[0-2])$|[①-⑫]"
GRID_MARGIN, MARGIN = 0.09, 0.025


def first_point(*points: Column) -> Column:
    """The first known of several places; null, not the origin, where none is."""
    return F.coalesce(*points)


def in_band(x: Column, y: Column, sheet: Box, share: float = MARGIN) -> Column:
    """Whether a place is in the outer band of a sheet, or off it; an unknown place is not."""
    dx, dy = (sheet[2] - sheet[0]) * share, (sheet[3] - sheet[1]) * share
    return F.coalesce(~in_box(x, y, (sheet[0] + dx, sheet[1] + dy, sheet[2] - dx, sheet[3] - dy)), F.lit(False))


def grid_label(text: Column, x: Column, y: Column, sheet: Box) -> Column:
    """Whether a text is a label of the margin's grid: a letter to H or a number to 12, or with a circled one, standing in the margin for it."""
    return F.coalesce(F.trim(text).rlike(GRID_LABEL), F.lit(False)) & in_band(x, y, sheet, GRID_MARGIN)


def in_margin(text: Column, x: Column, y: Column, sheet: Box) -> Column:
    """Whether something belongs to the margin: a grid label, or anything in the narrow outer band."""
    return grid_label(text, x, y, sheet) | in_band(x, y, sheet)


def too_large(box: tuple[Column, Column, Column, Column], sheet: Box, most: float = 0.70) -> Column:
    """Whether a box takes over ``most`` of the sheet, and so tells nothing; never on a sheet without an extent."""
    if sheet[2] <= sheet[0] or sheet[3] <= sheet[1]:
        return F.lit(False)
    area = (sheet[2] - sheet[0]) * (sheet[3] - sheet[1])
    return F.coalesce((box[2] - box[0]) * (box[3] - box[1]) / area > most, F.lit(False))


def calibrated(base: Column, multiplier: Column) -> Column:
    """A base confidence times a multiplier, within 0.1 and 1, to four places."""
    return F.round(F.least(F.greatest(base * multiplier, F.lit(0.1)), F.lit(1.0)), 4)


def marker_anchor(x: Column, y: Column, height: Column, text: Column, width_ratio: float = 0.6) -> tuple[Column, Column]:
    """Middle of a text as drawn: characters are ``width_ratio`` of their height wide."""
    return x + height * width_ratio * F.length(text) / 2, y + height / 2


def line_weight_mm(own: Column, layer: Column) -> Column:
    """Millimetres of a line weight in hundredths; the layer's where it leaves that to layer or block or is unknown, else, below zero, the default."""

    def plain(w: Column) -> Column:
        return F.when(w >= 0, F.round(w / 100.0, 4)).otherwise(F.lit(DEFAULT_MM))

    return F.when(F.coalesce(own, F.lit(BY_LAYER)).isin(BY_LAYER, BY_BLOCK), plain(layer)).otherwise(plain(own))


def stroke_colour(own: Column, layer: Column, block: Column, default: str = "#000000") -> Column:
    """Colour by index as a hex string: 256 is the layer's, 0 the block's; unknown ones are the default."""
    index = F.when(own == 256, layer).when(own == 0, block).otherwise(own)
    table = F.create_map(*[F.lit(v) for pair in INDEX_COLOURS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, index.cast("int")), F.lit(default))


def dash_pattern(own: Column, layer: Column, scale: Column) -> Column:
    """Lengths of dashes (array) times a scale, the layer's where an entity has none of its own."""
    return F.transform(F.coalesce(own, layer), lambda d: d * scale)


def to_view(x: Column, y: Column, centre: tuple[float, float], scale: float, turn: float, at: tuple[float, float]) -> tuple[Column, Column]:
    """A model place on the sheet: moved to the view's centre, turned, scaled, and set down at the view's place."""
    dx, dy = x - centre[0], y - centre[1]
    c, s = F.cos(F.lit(turn)), F.sin(F.lit(turn))
    return at[0] + scale * (dx * c - dy * s), at[1] + scale * (dx * s + dy * c)


def from_view(x: Column, y: Column, centre: tuple[float, float], scale: float, turn: float, at: tuple[float, float]) -> tuple[Column, Column]:
    """The way back of :func:`to_view`."""
    dx, dy = (x - at[0]) / scale, (y - at[1]) / scale
    c, s = F.cos(F.lit(turn)), F.sin(F.lit(turn))
    return centre[0] + dx * c + dy * s, centre[1] - dx * s + dy * c


REVISION = r"(?i)(?U)\b(?:REV|revision)\.?\s*([A-Z0-9]+)\b"  # fixed value; of "revision" the first alternative takes three letters


def revision_letter(texts: Column, default: str) -> Column:
    """What the last text (array, in order) that names a revision calls it, as written; else the default."""
    named = F.filter(F.transform(texts, lambda t: F.regexp_extract(F.btrim(t), REVISION, 1)), lambda t: t != "")
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(default))


def advanced_revision(old: Column, new: Column, differ: Column) -> Column:
    """``new``, but where it equals ``old`` and the files differ the letter after the old one's first; B where that is no letter."""
    first = F.substring(old, 1, 1)
    after = F.when(first.rlike(r"(?U)^\p{L}$"), F.char(F.ascii(first) + 1)).otherwise(F.lit("B"))
    return F.when((old == new) & differ, after).otherwise(new)


def text_of(*parts: Column) -> Column:
    """The first text that isn't empty, trimmed; the empty text where there is none."""
    return F.trim(F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit("")))
