"""Values of a title block by their place: below or beside a label, unless a rule stands between; and which band of a table holds its values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .folds import Assign, checkpointed, fold
from .ordered import columns_by_step
from .zones import folded

BASE_HEIGHT = 2.5
UPRIGHT, LEAST_RULE = 0.05, 0.5
STRETCH = 4.0
GAP_FACTOR = 2.5

# Words of labels, which are no values.
LABEL_WORDS = [
    "designed", "設計", "drawn", "製図", "approved", "承認", "checked", "照査",
    "scale", "尺度", "title", "図面名", "図名", "名称", "jobname",
    "jobno.", "工事番号", "unitcode", "mach.code", "ユニット記号", "機番記号", "機器記号",
    "dwg.no.", "図面番号", "dwgno", "previousdwg.no,", "旧図面番号", "crossrefno.", "共通番号",
    "符号", "年月日", "y/m/d", "amd.", "designchgno.", "dir.", "branch", "std.no.", "標準図番号",
    "machine type", "machinetype", "unit no.", "unitno.", "part no.", "partno.", "dir.", "branch", "amd.", "standard",
    "kusakabe", "electric", "machinery", "co.,ltd", "日下部電機", "t.q'ty", "t.q’ty", "総製作個数", "個数", "q'ty", "stockq'ty",
    "機種", "ユニット", "部品", "特性", "訂正符号",
]
# Characters of labels set one by one.
LABEL_CHARACTERS = "工事番号発尺度設計製図名称面個数単位前"
EAST_ASIAN = r"[一-龯぀-ゟ゠-ヿ]"


def bare(text: Column) -> Column:
    """Without blanks, in lower case."""
    return F.lower(F.replace(F.btrim(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit("")))


def is_label_text(text: Column) -> Column:
    """Whether a text is none that a field could have: empty, a label word, part of one or around one; of one or two characters without a letter or digit, or with a label's; a lone character of an East Asian script."""
    t, said = F.btrim(F.coalesce(text, F.lit(""))), bare(text)
    out = t == ""
    for word in LABEL_WORDS:
        w = word.replace(" ", "").lower()
        out |= F.contains(said, F.lit(w)) | F.contains(F.lit(w), said)
    short = ~t.rlike(r"[a-zA-Z0-9一-龯぀-ゟ゠-ヿ]") | t.rlike(f"[{LABEL_CHARACTERS}]")
    return out | ((F.char_length(t) <= 2) & short) | ((F.char_length(t) == 1) & t.rlike(EAST_ASIAN))


def vertical_rules(entities: DataFrame, kinds: tuple[str, ...] = ("line", "polyline", "lwpolyline")) -> DataFrame:
    """``sheet, x, low, high``: upright segments (under 0.05 aslant, over 0.5 long) of lines and polylines (sheet, kind, path). Points without both coordinates are passed over."""
    points = F.filter("path", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    rows = entities.where(F.col("kind").isin(*kinds)).select("sheet", points.alias("p")).where(F.size("p") >= 2)
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    s = rows.select("sheet", F.explode(pairs).alias("s")).select("sheet", "s.a", "s.b")
    s = s.where((F.abs(F.col("a.x") - F.col("b.x")) < UPRIGHT) & (F.abs(F.col("a.y") - F.col("b.y")) > LEAST_RULE))
    return s.select("sheet", F.col("a.x").alias("x"), F.least("a.y", "b.y").alias("low"), F.greatest("a.y", "b.y").alias("high"))


def text_scale(entities: DataFrame) -> DataFrame:
    """``sheet, scale``: the median height of a sheet's texts (those with one) over 2.5, between 1 and 3. By ranks, so no sheet is gathered."""
    rows = entities.where((F.col("kind") == "text") & (F.col("height") != 0)).select("sheet", F.col("height").cast("double").alias("h"))
    w = Window.partitionBy("sheet")
    placed = rows.withColumns({"place": F.row_number().over(w.orderBy("h")) - 1, "n": F.count(F.lit(1)).over(w)})
    half = F.floor(F.col("n") / 2)
    middle = placed.where((F.col("place") == half) | ((F.col("n") % 2 == 0) & (F.col("place") == half - 1)))
    return middle.groupBy("sheet").agg(F.least(F.greatest(F.avg("h") / BASE_HEIGHT, F.lit(1.0)), F.lit(3.0)).alias("scale"))


def chosen_labels(texts: DataFrame, fields: DataFrame) -> DataFrame:
    """``sheet, field, ord, x, y``: the text that is a field's label: one equal to a pattern, else one that holds one of over two characters; the lowest, highest or first by ord.

    fields: ``field, patterns, excluded`` (arrays), ``prefer`` (low, high or first); a small table, as many rows as a title block has fields. Texts that hold an excluded word are no labels.
    Blanks and case don't count. Fields come to the texts by broadcast, so each text is read once; equal patterns are an array test and no join.
    """
    t = texts.select("sheet", "ord", "x", "y", bare(F.col("text")).alias("said"))
    squeeze = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.lower(F.replace(p, F.lit(" "), F.lit(""))))
    f = fields.select("field", squeeze(F.col("patterns")).alias("patterns"), squeeze(F.col("excluded")).alias("excluded"), "prefer")
    named = F.exists("patterns", lambda p: p == F.col("said"))
    held = F.exists("patterns", lambda p: (F.char_length(p) > 2) & F.contains(F.col("said"), p))
    ruled_out = F.exists("excluded", lambda p: F.contains(F.col("said"), p))
    met = t.join(F.broadcast(f), (named | held) & ~ruled_out)
    rank = F.struct(
        F.when(named, 0).otherwise(1).alias("tier"),
        F.when(F.col("prefer") == "low", F.col("y")).when(F.col("prefer") == "high", -F.col("y")).otherwise(F.lit(0.0)).alias("height"),
        "ord",
    )
    return met.groupBy("sheet", "field").agg(F.min_by(F.struct("ord", "x", "y"), rank).alias("at")).select("sheet", "field", "at.*")


def nearest_values(labels: DataFrame, texts: DataFrame, rules: DataFrame, scales: DataFrame) -> DataFrame:
    """``sheet, field, value, value_ord, distance`` for every label (sheet, field, ord, x, y, direction, reach_x, reach_y, least, excluded); nulls where it has no value.

    below: a text at most reach_x aside and least to reach_y under the label, with sideways counting four times, and no upright rule between the two that spans both heights. right: a text least to
    reach_x to the right, at most reach_y (25 at least) up or down, which counts four times; rules don't matter. All lengths are times the sheet's scale. The nearest counts, of equally near ones the
    first by ord. Label texts (:func:`is_label_text`) and those with an excluded word are no values.

    A label looks only at the texts of the grid cells that its reach touches, and rules are met by intervals: a rule belongs to the cells of x that it stands in, and a pair of label and value asks
    for the cells between them, so neither makes all pairs of a sheet.
    """
    v = texts.where(~is_label_text(F.col("text"))).select("sheet", F.col("ord").alias("v_ord"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.btrim("text").alias("value"))
    scaled = labels.join(scales, "sheet", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    below = F.col("direction") == "below"
    rx, ry, least = F.col("reach_x") * F.col("scale"), F.col("reach_y") * F.col("scale"), F.col("least") * F.col("scale")
    ry = F.when(below, ry).otherwise(F.greatest(ry, 25.0 * F.col("scale")))
    excluded = F.transform(F.coalesce("excluded", F.array().cast("array<string>")), lambda p: F.lower(F.replace(p, F.lit(" "), F.lit(""))))
    l = scaled.select("sheet", "field", "ord", "x", "y", below.alias("below"), rx.alias("rx"), ry.alias("ry"), least.alias("least"), excluded.alias("excluded"))  # noqa: E741
    size = 25.0
    cells = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    left, right = F.when(F.col("below"), F.col("x") - F.col("rx")).otherwise(F.col("x")), F.col("x") + F.col("rx")
    low, high = F.col("y") - F.col("ry"), F.when(F.col("below"), F.col("y")).otherwise(F.col("y") + F.col("ry"))
    asked = l.withColumn("cx", F.explode(cells(left, right))).withColumn("cy", F.explode(cells(low, high)))
    at = v.withColumns({"cx": F.floor(F.col("vx") / size), "cy": F.floor(F.col("vy") / size)})
    dx, dy = F.col("vx") - F.col("x"), F.col("vy") - F.col("y")
    fits = F.when(F.col("below"), (F.abs(dx) <= F.col("rx")) & (-dy).between(F.col("least"), F.col("ry"))).otherwise((F.abs(dy) <= F.col("ry")) & dx.between(F.col("least"), F.col("rx")))
    pairs = asked.join(at, ["sheet", "cx", "cy"]).where(fits & (F.col("ord") != F.col("v_ord")) & ~F.exists("excluded", lambda p: F.contains(bare(F.col("value")), p)))
    distance = F.when(F.col("below"), F.hypot(STRETCH * dx, dy)).otherwise(F.hypot(dx, STRETCH * dy))
    pairs = pairs.select("sheet", "field", "x", "y", "below", "v_ord", "vx", "vy", "value", distance.alias("distance"))
    between = pairs.where("below").select("sheet", "field", "v_ord", *[f(a, b).alias(n) for f, a, b, n in ((F.least, "x", "vx", "x_lo"), (F.greatest, "x", "vx", "x_hi"), (F.least, "y", "vy", "y_lo"), (F.greatest, "y", "vy", "y_hi"))])
    between = between.withColumn("cx", F.explode(cells(F.col("x_lo"), F.col("x_hi"))))
    r = rules.select("sheet", F.col("x").alias("rule_x"), "low", "high", F.floor(F.col("x") / size).alias("cx"))
    stands = (F.col("rule_x") > F.col("x_lo")) & (F.col("rule_x") < F.col("x_hi")) & (F.col("low") <= F.col("y_lo")) & (F.col("y_hi") <= F.col("high"))
    parted = between.join(r, ["sheet", "cx"]).where(stands).select("sheet", "field", "v_ord").distinct()
    best = pairs.join(parted, ["sheet", "field", "v_ord"], "left_anti").groupBy("sheet", "field").agg(F.min(F.struct("distance", "v_ord", "value")).alias("best"))
    return labels.select("sheet", "field").join(best, ["sheet", "field"], "left").select("sheet", "field", "best.value", F.col("best.v_ord").alias("value_ord"), "best.distance")


def field_values(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """``sheet, field, label_ord, value, value_ord, distance`` for every field whose label is on a sheet: label, scale, rules and nearest value in one.

    entities: ``sheet, ord, kind, text, x, y, height, path``; fields as for :func:`chosen_labels`, with ``direction, reach_x, reach_y, least``. Texts without a place take no part. Fields without a label
    have no row. See :func:`nearest_values`.
    """
    texts = entities.where((F.col("kind") == "text") & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.btrim(F.coalesce("text", F.lit(""))) != ""))
    labels = chosen_labels(texts, fields).join(F.broadcast(fields.select("field", "direction", "reach_x", "reach_y", "least", "excluded")), "field")
    values = nearest_values(labels, texts, vertical_rules(entities), text_scale(entities))
    return labels.select("sheet", "field", F.col("ord").alias("label_ord")).join(values, ["sheet", "field"])


def value_band(bands: DataFrame, factor: float = GAP_FACTOR) -> DataFrame:
    """``table, band``: which band of each table holds its values; the lowest, but for bands that have drifted in.

    bands: ``table, band, x, y``, a row a cell, bands counted from the top. Columns are the x of the top band, cut at steps over a quarter of the largest (:func:`.ordered.columns_by_step`). From the third band on, the first that both stands further below the one above than
    ``factor`` times every gap so far and covers under half the columns ends the table: the band above it is the one. A cell covers the nearest column, if within half the (upper median) column pitch. Tables of under three
    bands have their last. Bands are aggregates, gaps and their maxima windows over a table's few bands.
    """
    height = bands.groupBy("table", "band").agg(F.max("y").alias("y"))
    w = Window.partitionBy("table").orderBy("band")
    gaps = height.withColumn("gap", F.lag("y").over(w) - F.col("y"))
    gaps = gaps.withColumn("most", F.max("gap").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    columns = columns_by_step(bands.where("band = 0 and x is not null"), ["table"], "x").select("table", F.col("col").alias("column"), F.col("center").alias("column_x"))
    steps = columns.withColumn("step", F.col("column_x") - F.lag("column_x").over(Window.partitionBy("table").orderBy("column"))).where("step is not null")
    ranked = steps.withColumns({"place": F.row_number().over(Window.partitionBy("table").orderBy("step")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("table"))})
    pitch = ranked.where(F.col("place") == F.floor(F.col("n") / 2)).select("table", (F.col("step") / 2).alias("within"))
    n_columns = columns.groupBy("table").agg(F.count(F.lit(1)).alias("n_columns"))
    cells = bands.join(columns, "table").groupBy("table", "band", "x", "y").agg(F.min(F.struct(F.abs(F.col("x") - F.col("column_x")).alias("off"), "column")).alias("near"))
    covered = cells.join(pitch, "table", "left").where(F.coalesce(F.col("near.off") <= F.col("within"), F.lit(True)))
    covered = covered.groupBy("table", "band").agg(F.count_distinct("near.column").alias("covered"))
    rows = gaps.join(n_columns, "table").join(covered, ["table", "band"], "left")
    fills = F.coalesce("covered", F.lit(0)) >= F.greatest(F.lit(1), F.floor(F.col("n_columns") / 2))
    strayed = F.coalesce((F.col("band") >= 2) & (F.col("gap") > F.col("most") * factor) & ~fills, F.lit(False))
    n = rows.groupBy("table").agg(F.max("band").alias("last"), F.min(F.when(strayed, F.col("band") - 1)).alias("cut"))
    return n.select("table", F.coalesce("cut", "last").alias("band"))


TEXTS = ["text", "mtext", "attrib"]
BAND_GAP, EDGE, LEAST_REACH, REACH_FACTOR = 4.0, 0.08, 30.0, 1.5
CIRCLED = "[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]"
# Headers that mean the same, in letters, digits and East Asian signs alone.
SYNONYMS = [("unitno", "ユニットno"), ("partno", "コードno"), ("tqty", "総製作個数"), ("stockqty", "在庫棚入庫")]


def title_fields(entities: DataFrame, boxes: DataFrame) -> DataFrame:
    """``sheet, place, key, value, x, y``: the values of the table in each sheet's box (sheet, xmin, ymin, xmax, ymax), each with the headers above it.

    entities: ``sheet, ord, kind, text, x, y``. Texts of the box, but for grid labels (one character at most or a circled number, in the left or upper 8 in 100), form bands from the top: a new one where a text is over 4 units below the one before. The band of
    values is that of :func:`value_band`; a table needs a band of headers above it. A value takes from every header band the header nearest in x, if that is within one and a half of the mean column width (30 at least); equal texts once, numbers not, the lowest band first, joined
    by `` / ``; ``Value`` without any. Blank values are none. place counts from the left.

    The nearest header is found by a window over headers and values in order of x, from either side, so headers and values of a table make no pairs.
    """
    b = boxes.select("sheet", F.struct("xmin", "ymin", "xmax", "ymax").alias("b"))
    e = entities.where(F.col("kind").isin(TEXTS) & F.col("x").isNotNull() & F.col("y").isNotNull()).select("sheet", "ord", F.btrim(F.coalesce("text", F.lit(""))).alias("text"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    e = e.join(b, "sheet").where(F.col("x").between(F.col("b.xmin"), F.col("b.xmax")) & F.col("y").between(F.col("b.ymin"), F.col("b.ymax")))
    size = lambda lo, hi: F.coalesce(F.nullif(F.col(f"b.{hi}") - F.col(f"b.{lo}"), F.lit(0.0)), F.lit(1.0))
    edge = (F.col("x") < F.col("b.xmin") + EDGE * size("xmin", "xmax")) | (F.col("y") > F.col("b.ymax") - EDGE * size("ymin", "ymax"))
    e = e.where(~(((F.char_length("text") <= 1) | F.col("text").rlike(CIRCLED)) & edge)).drop("b")
    down = Window.partitionBy("sheet").orderBy(F.desc("y"), "ord")
    step = F.when(F.lag("y").over(down) - F.col("y") > BAND_GAP, 1).otherwise(0)
    e = e.withColumns({"step": step, "rank": F.row_number().over(down)})
    e = checkpointed(e.withColumn("band", F.sum("step").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("step"))
    bands = e.groupBy("sheet").agg(F.max("band").alias("last"), (F.max("x") - F.min("x")).alias("wide"), F.count(F.lit(1)).alias("n")).where("last >= 1")
    chosen = value_band(e.join(bands.select("sheet"), "sheet", "left_semi").select(F.col("sheet").alias("table"), "band", "x", "y")).withColumnsRenamed({"table": "sheet", "band": "value_band"}).where("value_band >= 1")
    e = e.join(chosen, "sheet").where(F.col("band") <= F.col("value_band"))
    left = Window.partitionBy("sheet").orderBy("x", "rank")
    values = e.where("band = value_band").withColumn("place", F.row_number().over(left))
    n_values = values.groupBy("sheet").agg(F.count(F.lit(1)).alias("n_values"))
    wide = F.when(F.col("n") > 1, F.col("wide")).otherwise(F.lit(9999.0))
    reach = bands.join(n_values, "sheet").select("sheet", F.greatest(wide / F.col("n_values") * REACH_FACTOR, F.lit(LEAST_REACH)).alias("reach"))
    asked = values.where("text <> ''").select("sheet", "place", "x", F.explode(F.sequence(F.lit(0), F.col("value_band") - 1)).alias("band"))
    none = F.lit(None)
    rows = e.where("band < value_band").select("sheet", "band", "x", "rank", F.struct("x", "rank", "text").alias("header"), none.cast("int").alias("place"))
    rows = rows.union(asked.select("sheet", "band", "x", none.cast("int"), none.cast("struct<x:double,rank:int,text:string>"), "place"))
    # Of headers at one place the first in the band's order counts; a value sees those at its own place from both sides.
    own = F.coalesce("rank", F.lit(0))
    before = Window.partitionBy("sheet", "band").orderBy("x", F.when(F.col("place").isNotNull(), 1).otherwise(0), F.desc(own)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("sheet", "band").orderBy(F.desc("x"), F.when(F.col("place").isNotNull(), 1).otherwise(0), F.desc(own)).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"l": F.last("header", ignorenulls=True).over(before), "r": F.last("header", ignorenulls=True).over(after)}).where("place is not null")
    off = lambda h: F.abs(F.col(f"{h}.x") - F.col("x"))
    first = F.col("r").isNull() | (off("l") < off("r")) | ((off("l") == off("r")) & (F.col("l.rank") <= F.col("r.rank")))
    seen = seen.withColumn("h", F.when(F.coalesce(first, F.lit(False)) & F.col("l").isNotNull(), F.col("l")).otherwise(F.col("r"))).join(reach, "sheet")
    told = seen.where((F.abs(F.col("h.x") - F.col("x")) <= F.col("reach")) & (F.col("h.text") != "") & ~F.col("h.text").rlike(r"(?U)^\d+$"))
    keys = told.groupBy("sheet", "place").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("band", F.col("h.text").alias("text")))), lambda p: p["text"])).alias("parts"))
    parts = F.filter(F.reverse("parts"), lambda p: ~p.rlike("^[①②③④]"))
    key = F.when(F.size(parts) > 0, F.array_join(parts, " / ")).otherwise("Value")
    return values.where("text <> ''").join(keys, ["sheet", "place"], "left").select("sheet", "place", F.when(F.col("parts").isNull(), "Value").otherwise(key).alias("key"), F.col("text").alias("value"), "x", "y")


def matched_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """``sheet, old_place, new_place, old_key, new_key, old_value, new_value``: fields of two revisions (sheet, place, key, value) side by side; one side null where a field has no partner.

    Old fields take, in order, the first new one left that shares a header with them (headers are parted by `` / ``, and equal in NFKC, lower case and single blanks), else the first that has one of the same meaning. Candidates come from equal headers; only the taking goes by order, and holds the
    places taken.
    """
    parts = lambda df, side: df.select("sheet", F.col("place").alias(f"{side}_place"), F.explode(F.filter(F.transform(F.split(folded(F.replace("key", F.lit(" / "), F.lit("\u0000"))), "\u0000"), F.btrim), lambda p: p != "")).alias("header")).distinct()
    a, b = parts(old, "old"), parts(new, "new")
    bare_header = F.regexp_replace("header", r"[^0-9a-z぀-ヿ一-鿿]", "")
    group = F.coalesce(*[F.when(bare_header.isin(*g), F.lit(k)) for k, g in enumerate(SYNONYMS)])
    meaning = lambda df, side: df.select("sheet", f"{side}_place", group.alias("group")).where("group is not null").distinct()
    exact = a.join(b, ["sheet", "header"]).select("sheet", "old_place", "new_place", F.lit(0).alias("tier"))
    alike = meaning(a, "old").join(meaning(b, "new"), ["sheet", "group"]).select("sheet", "old_place", "new_place", F.lit(1).alias("tier"))
    edges = exact.union(alike).groupBy("sheet", "old_place", "new_place").agg(F.min("tier").alias("tier"))
    taken = fold(edges.withColumnsRenamed({"old_place": "old", "new_place": "new"}), ["sheet"], ["old", "tier", "new"], Assign, "took_old int, took_new int")
    side = lambda df, s: df.select("sheet", F.col("place").alias(f"{s}_place"), F.col("key").alias(f"{s}_key"), F.col("value").alias(f"{s}_value"))
    with_old = side(old, "old").join(taken.select("sheet", F.col("took_old").alias("old_place"), F.col("took_new").alias("new_place")), ["sheet", "old_place"], "left")
    both = with_old.join(side(new, "new"), ["sheet", "new_place"], "full")
    return both.select("sheet", "old_place", "new_place", "old_key", "new_key", "old_value", "new_value")
