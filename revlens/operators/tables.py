"""Tables read from texts that stand in a grid: rows by height, cells by share of the width, headers, and pointers to other tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.text import nfkc

from .folds import fold

ROW_REACH, LEAST_CELLS, WIDEST = 4.0, 4, 800.0
DEFER_REACH = 6.0
NUMBER = "^[0-9]{1,3}$|^[a-zA-Z]$"
# Words that tell a list of parts from one of assemblies, labels of header rows, pointers to another table, and right ends of cells as shares of the width.
PARTS_WORDS = ["material wt", "仕上重量", "finished wt", "材質", "寸法"]
HEADER_LABELS = [
    "no.", "no", "q'ty", "qty", "quantity", "remark", "remarks", "備考",
    "material wt", "finished wt", "material weight", "finished weight",
    "材質", "寸法", "code", "dimension", "dimension/model no",
    "dwg no", "dwg. no", "図面番号", "title", "名称",
    "材料寸法", "型式", "材料個数", "素材重量", "仕上重量",
    "material weight(kg)", "finished weight(kg)",
]
DEFERRED = ["表ニヨル", "表による", "表ニ依ル", "別表による", "別表"]
ASSEMBLY_CELLS = [("DWG_NO", 0.50), ("TITLE", 0.82), ("QTY", 0.92), ("REMARK", None)]
PARTS_CELLS = [("CODE", 0.32), ("DIMENSION", 0.64), ("QTY", 0.74), ("MATERIAL_WEIGHT", 0.84), ("FINISHED_WEIGHT", 0.93), ("REMARK", None)]
FIELDS = ["CODE", "DIMENSION", "DWG_NO", "TITLE", "QTY", "MATERIAL_WEIGHT", "FINISHED_WEIGHT", "REMARK"]
# Headers of a table of amendments.
AMENDMENT_HEADERS = [
    "amd.", "amd", "design chg no.", "design chg no", "previous dwg. no,", "previous dwg. no.", "previous dwg no", "y/m/d", "name",
    "旧図面番号", "旧工事番号", "訂正符号", "設計訂正書no.", "設計訂正書no", "年月日", "担当", "符号",
]


class _Rows:
    """Rows of one table so far, as sums and counts of y; a cell joins the first whose mean is near."""

    def __init__(self):
        self.sums: list[float] = []
        self.counts: list[int] = []

    def take(self, rows: pa.Table) -> list[tuple]:
        out = []
        for ord_, y, reach in zip(rows["ord"].to_pylist(), rows["y"].to_pylist(), rows["reach"].to_pylist(), strict=True):
            at = next((k for k, (s, n) in enumerate(zip(self.sums, self.counts, strict=True)) if abs(y - s / n) <= reach), len(self.sums))
            if at == len(self.sums):
                self.sums.append(0.0)
                self.counts.append(0)
            self.sums[at] += y
            self.counts[at] += 1
            out.append((ord_, at))
        return out

    def end(self) -> list[tuple]:
        return []


def text_rows(cells: DataFrame) -> DataFrame:
    """``sheet, ord, row``: cells (sheet, ord, y, reach), in the order of ord, in rows; one joins the first row whose mean y so far is within its reach, else begins one.

    The mean moves with each cell, so the order matters; the fold keeps two numbers a row and no cells.
    """
    return fold(cells.select("sheet", "ord", F.col("y").cast("double").alias("y"), F.col("reach").cast("double").alias("reach")), ["sheet"], ["ord"], _Rows, "ord long, row int")


def _is_header(cell: Column) -> Column:
    said = F.replace(F.replace(F.lower(F.btrim(cell)), F.lit("　"), F.lit(" ")), F.lit("  "), F.lit(" "))
    out = said.isin(HEADER_LABELS)
    for label in HEADER_LABELS:
        if len(label) > 3:
            out |= F.startswith(said, F.lit(label))
    return out


def _named(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("NONE")).otherwise(F.btrim(value))


def table_rows(entities: DataFrame, boxes: DataFrame | None = None, widths: DataFrame | None = None) -> DataFrame:
    """``sheet, row, assembly, NO`` and the fields of FIELDS (null: not one of this kind of table): the rows of each sheet's list of parts.

    entities: ``sheet, ord, kind, text, x, y``, of which texts count (a text without a place stands at 0, 0); boxes: ``sheet, xmin, ymin, xmax, ymax`` of the list (without: from 0, 0 to the furthest text). Lengths double on
    sheets of over 1,200 units (widths: ``sheet, width``) or, where no width is known, with a text between 1,000 and 5,000.

    Texts of the box are grouped into rows (:func:`text_rows`, 4 units). A row counts with four cells or more, a number of up to three digits or a letter among its first two, and no header label. Cells go into fields by their share
    of the table's width: the box's, or, for none or one over 800, that of all rows with four cells; several in one field are joined by blanks, and cells equal to the row's number are it. No amount is 1, an empty field NONE. A list is one of
    assemblies unless a text of the sheet says otherwise. A sheet without such rows gets one, if a text points to another table: the rightmost number left of it and within 6 units of its height, or 1.

    Cells of a row are gathered, rows of a sheet are not. Ties of x go by ord.
    """
    said = F.btrim(F.coalesce("text", F.lit("")))
    texts = entities.where(F.col("kind") == "text").select("sheet", "ord", said.alias("value"), F.coalesce("x", F.lit(0.0)).cast("double").alias("x"), F.coalesce("y", F.lit(0.0)).cast("double").alias("y")).where("value <> ''")
    plain = F.lower("value")
    parts_word = F.lit(False)
    for w in PARTS_WORDS:
        parts_word |= F.contains(plain, F.lit(w))
    sheets = texts.groupBy("sheet").agg((~F.max(parts_word)).alias("assembly"), F.max("x").alias("far_x"), F.max("y").alias("far_y"), F.max((F.col("x") > 1000) & (F.col("x") < 5000)).alias("far"))
    if widths is not None:
        sheets = sheets.join(widths.select("sheet", "width"), "sheet", "left")
    else:
        sheets = sheets.withColumn("width", F.lit(None).cast("double"))
    if boxes is not None:
        sheets = sheets.join(boxes.select("sheet", F.struct("xmin", "ymin", "xmax", "ymax").alias("box")), "sheet", "left")
    else:
        sheets = sheets.withColumn("box", F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>"))
    scale = F.when(F.when(F.col("width").isNotNull(), F.col("width") > 1200).otherwise(F.col("far")), 2.0).otherwise(1.0)
    sheets = sheets.select("sheet", "assembly", "box", scale.alias("scale"), *[F.coalesce(f"box.{b}", rest).alias(a) for a, b, rest in (("x0", "xmin", F.lit(0.0)), ("y0", "ymin", F.lit(0.0)), ("x1", "xmax", F.col("far_x")), ("y1", "ymax", F.col("far_y")))])
    inside = texts.join(sheets, "sheet").where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    rows = text_rows(inside.select("sheet", "ord", "y", (ROW_REACH * F.col("scale")).alias("reach")))
    cell = F.struct("x", "ord", "value")
    grouped = inside.join(rows, ["sheet", "ord"]).groupBy("sheet", "row").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.min("x").alias("low"), F.max("x").alias("high"))
    grouped = grouped.where(F.size("cells") >= LEAST_CELLS)
    extent = grouped.groupBy("sheet").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    grouped = grouped.drop("low", "high").join(sheets, "sheet").join(extent, "sheet")
    boxed = F.when(F.col("box.xmax") > F.col("box.xmin"), F.col("box.xmax") - F.col("box.xmin")).otherwise(100.0)
    own = F.col("box").isNull() | (boxed > WIDEST)
    start = F.when(own, F.col("low")).otherwise(F.col("box.xmin"))
    wide = F.when(own, F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(100.0)).otherwise(boxed)
    number = F.get(F.filter(F.slice("cells", 1, 2), lambda c: c["value"].rlike(NUMBER)), F.lit(0))["value"]
    good = grouped.withColumns({"number": number, "start": start, "wide": wide})
    good = good.where(F.col("number").isNotNull() & ~F.exists("cells", lambda c: _is_header(c["value"])))

    def fields(named: list[tuple[str, float | None]]) -> dict[str, Column]:
        """Text of each field: the cells from the right end of the one before to its own."""

        def held(low: float | None, high: float | None):
            def test(c: Column) -> Column:
                share = F.when(F.col("wide") > 0, (c["x"] - F.col("start")) / F.col("wide")).otherwise(0.0)
                ok = c["value"] != F.col("number")
                ok = ok if low is None else ok & (share >= low)
                return ok if high is None else ok & (share < high)

            return test

        lows = [None, *[high for _, high in named]]
        return {name: F.array_join(F.transform(F.filter("cells", held(low, high)), lambda c: c["value"]), " ") for low, (name, high) in zip(lows, named, strict=False)}

    assembly, parts = fields(ASSEMBLY_CELLS), fields(PARTS_CELLS)

    def shown(name: str) -> Column:
        rest = F.lit(None).cast("string")
        a, p = assembly.get(name, rest), parts.get(name, rest)
        said = F.when(F.col("assembly"), a).otherwise(p)
        if name == "QTY":
            return F.when(said == "", F.lit("1")).otherwise(said).alias(name)
        return F.when(said.isNotNull(), _named(said)).alias(name)

    found = good.select("sheet", "row", "assembly", F.col("number").alias("NO"), *[shown(n) for n in FIELDS])
    pointer = F.lit(False)
    for w in DEFERRED:
        pointer |= F.contains(F.replace("value", F.lit(" "), F.lit("")), F.lit(w))
    points = inside.where(pointer).groupBy("sheet", "assembly", "scale").agg(F.min_by(F.struct(F.col("x").alias("px"), F.col("y").alias("py"), F.col("value").alias("said")), "ord").alias("p"))
    points = points.join(found.select("sheet").distinct(), "sheet", "left_anti").select("sheet", "assembly", "scale", "p.*")
    beside = (F.abs(F.col("y") - F.col("py")) <= DEFER_REACH * F.col("scale")) & (F.col("x") < F.col("px")) & F.col("value").rlike("^[0-9]{1,3}$")
    left = inside.select("sheet", "ord", "x", "y", "value").join(points.select("sheet", "px", "py", "scale"), "sheet").where(beside).groupBy("sheet").agg(F.max_by("value", F.struct("x", -F.col("ord"))).alias("number"))
    nothing = {n: F.when(F.col("assembly") == (n in ("DWG_NO", "TITLE")), F.lit("NONE")) for n in FIELDS if n not in ("QTY", "REMARK")}
    nothing["TITLE"] = F.when(F.col("assembly"), F.btrim("said"))
    nothing["CODE"] = F.when(~F.col("assembly"), F.btrim("said"))
    nothing |= {"QTY": F.lit("1"), "REMARK": F.lit("NONE")}
    deferred = points.join(left, "sheet", "left").select("sheet", F.lit(-1).alias("row"), "assembly", F.coalesce("number", F.lit("1")).alias("NO"), *[nothing[n].alias(n) for n in FIELDS])
    return found.union(deferred)


class _FirstFit:
    """Clusters of points so far; a point joins the first that has a member within reach."""

    def __init__(self):
        self.clusters: list[list[tuple[float, float]]] = []

    def take(self, rows: pa.Table) -> list[tuple]:
        out = []
        for ord_, x, y, reach in zip(*(rows[c].to_pylist() for c in ("ord", "x", "y", "reach")), strict=True):
            at = next((k for k, c in enumerate(self.clusters) if any((x - a) ** 2 + (y - b) ** 2 <= reach * reach for a, b in c)), len(self.clusters))
            if at == len(self.clusters):
                self.clusters.append([])
            if (x, y) not in self.clusters[at]:
                self.clusters[at].append((x, y))
            out.append((ord_, at))
        return out

    def end(self) -> list[tuple]:
        return []


def amendment_boxes(entities: DataFrame, bounds: DataFrame) -> DataFrame:
    """``sheet, cluster, xmin, ymin, xmax, ymax``: boxes of the tables of amendments, found by two header texts or more that stand together.

    Headers, in the order of ord, join the first cluster that has a member within 6 in 100 of the sheet's diagonal (1,000 where unknown); the fold keeps the places of the sheet's headers alone. Boxes are padded by a quarter of their width
    (20 at least) and half their height (30 at least). Those of over a fifth of a sheet with an area are none.
    """
    headers = entities.where(F.lower(F.btrim(nfkc(F.coalesce("text", F.lit(""))))).isin(AMENDMENT_HEADERS) & F.col("x").isNotNull() & F.col("y").isNotNull())
    size = bounds.select("sheet", (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))
    placed = headers.select("sheet", "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(size, "sheet", "left")
    placed = placed.withColumn("reach", F.coalesce(F.hypot("w", "h"), F.lit(1000.0)) * 0.06)
    clusters = fold(placed.select("sheet", "ord", "x", "y", "reach"), ["sheet"], ["ord"], _FirstFit, "ord long, cluster int")
    own = placed.join(clusters, ["sheet", "ord"]).groupBy("sheet", "cluster", "w", "h").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).where("n >= 2")
    px, py = F.greatest(F.lit(20.0), (F.col("x1") - F.col("x0")) * 0.25), F.greatest(F.lit(30.0), (F.col("y1") - F.col("y0")) * 0.50)
    boxes = own.select("sheet", "cluster", "w", "h", (F.col("x0") - px).alias("xmin"), (F.col("y0") - py).alias("ymin"), (F.col("x1") + px).alias("xmax"), (F.col("y1") + py).alias("ymax"))
    large = (F.col("w") > 0) & (F.col("h") > 0) & ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) / (F.col("w") * F.col("h")) > 0.20)
    return boxes.where(~F.coalesce(large, F.lit(False))).select("sheet", "cluster", "xmin", "ymin", "xmax", "ymax")
