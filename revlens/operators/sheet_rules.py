"""Drafting rules on the entities of sheets, R01 to R19; each gives rows ``sheet, rule, subject, detail``.

Entities are rows ``sheet, ord, kind, layer, text`` with, where a rule needs it, ``x1, y1, x2, y2`` (lines), ``radius`` (circles), ``height, space`` (texts), ``measurement`` (dimensions) or ``attributes`` (a map, of blocks). Texts are trimmed; null is empty. Rules on a whole sheet are
conditional counts, those that report the first few windows by sheet; no sheet is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Names, words, patterns and measures of the rules.
LAYERS = ["0", "defpoints", "am_0", "am_1", "am_bor", "am_txt", "am_dim", "border", "title", "dimensions", "geometry"]
FORBIDDEN = ["temp", "draft", "delete", "backup", "test", "work", "junk"]
TITLE_LAYERS = ["am_bor", "border", "title", "title_block"]
SCALES = ["1:1", "1:2", "1:5", "1:10", "1:20", "1:50", "1:100", "2:1", "5:1", "10:1"]
TOLERANCES = ["iso 2768", "jis b 0405", "asme y14.5", "din 7168", "一般公差", "general tolerance"]
PLACEHOLDERS = ["n/a", "unknown", "insert", "placeholder", "company name", "designer", "---", "xxxx"]
FRAME_SIGNS = ["⊙", "⌖", "⊥", "◎", "⊘", "∥", "↗", "⌯", "⌒", "⏊"]
FRAME = r"(\|[a-zA-Z0-9.\s⌀/]+\|[a-zA-Z0-9.\s]+\|?)"
HEIGHTS = [2.5, 3.5, 5.0, 7.0, 10.0, 14.0]
THREAD = r"(?i)(?U)\b(M\s*\d+)\b"
ROUGHNESS = ["ra", "ry", "rz", "roughness"]


def said(text: str = "text") -> Column:
    return F.btrim(F.coalesce(F.col(text), F.lit("")))


def _rows(df: DataFrame, rule: str, subject: Column, detail: Column) -> DataFrame:
    return df.select("sheet", F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def _first(df: DataFrame, most: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("sheet").orderBy("ord"))).where(F.col("__n") <= most)


def _any(values: list[str], text: Column) -> Column:
    out = F.lit(False)
    for v in values:
        out |= F.contains(text, F.lit(v))
    return out


def _sheets(e: DataFrame, rule: str, fires: Column, detail: Column, **counts: Column) -> DataFrame:
    """One row for each sheet on which ``fires``, said of its counts (conditions that hold for an entity)."""
    n = e.groupBy("sheet").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()])
    return _rows(n.where(fires), rule, F.col("sheet"), detail)


def forbidden_layers(e: DataFrame) -> DataFrame:
    """R01, first half: every entity on a scratch layer."""
    return _rows(e.where(_any(FORBIDDEN, F.lower("layer"))), "forbidden_layer_name", F.col("ord"), F.col("layer"))


def unknown_layers(e: DataFrame) -> DataFrame:
    """R01, second half: every layer, once, that is neither a standard nor a scratch one."""
    odd = e.where(~F.lower("layer").isin(LAYERS) & ~_any(FORBIDDEN, F.lower("layer"))).select("sheet", "layer").distinct()
    return _rows(odd, "invalid_layer", F.col("layer"), F.col("layer"))


def duplicate_lines(e: DataFrame, most: int = 5) -> DataFrame:
    """Lines with the ends, in either direction, of an earlier one; the first five of a sheet."""
    a, b = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2))
    lines = e.where((F.col("kind") == "line") & F.col("x1").isNotNull() & F.col("x2").isNotNull())
    lines = lines.withColumns({"__a": F.least(a, b), "__b": F.greatest(a, b)})
    seen = lines.withColumn("__k", F.row_number().over(Window.partitionBy("sheet", "__a", "__b").orderBy("ord"))).where("__k > 1")
    return _rows(_first(seen, most), "duplicate_entities", F.col("ord"), F.format_string("%s %s %s %s", "x1", "y1", "x2", "y2"))


def few_dimensions(e: DataFrame) -> DataFrame:
    """Over ten lines, circles, arcs and polylines, and under two dimensions."""
    return _sheets(
        e, "missing_dimensions", (F.col("shapes") > 10) & (F.col("dims") < 2), F.concat_ws("/", "shapes", "dims"),
        shapes=F.col("kind").isin("line", "circle", "arc", "polyline"), dims=F.col("kind") == "dimension",
    )


def odd_scales(e: DataFrame) -> DataFrame:
    """Texts that state a scale, with a colon or a stroke, which is not one of the standard's."""
    scale = F.regexp_replace(F.replace(F.regexp_extract(said(), r"(?i)scale\s*:?\s*(\d+\s*[:/]\s*\d+)", 1), F.lit(" "), F.lit("")), "/", ":")
    return _rows(e.where(F.col("kind") == "text").withColumn("__s", scale).where((F.col("__s") != "") & ~F.col("__s").isin(SCALES)), "invalid_scale", F.col("ord"), F.col("__s"))


def off_dimensions(e: DataFrame, most: int = 2) -> DataFrame:
    """Dimensions whose text, digits and points of it, is over 5 in 100 off the measurement times the sheet's scale, and isn't that rounded (halves to even). The scale is the first by ord that is over something; the first two of a sheet are told."""
    stated = e.where(said() != "").select("sheet", "ord", F.regexp_extract(said(), r"(?i)scale\s*:?\s*(\d+)\s*[:/]\s*(\d+)", 1).alias("a"), F.regexp_extract(said(), r"(?i)scale\s*:?\s*(\d+)\s*[:/]\s*(\d+)", 2).alias("b"))
    stated = stated.where("a <> ''").select("sheet", "ord", F.expr("try_cast(a as double)").alias("a"), F.expr("try_cast(b as double)").alias("b")).where("b > 0")
    scale = stated.groupBy("sheet").agg(F.min_by(F.col("a") / F.col("b"), "ord").alias("__scale"))
    dims = e.where((F.col("kind") == "dimension") & F.col("measurement").isNotNull()).withColumn("__t", F.regexp_replace(said(), r"[^\d.]", ""))
    dims = dims.withColumn("__v", F.expr("try_cast(__t as double)")).where("__v > 0").join(scale, "sheet", "left")
    expected = F.col("measurement") * F.coalesce("__scale", F.lit(1.0))
    share = F.when(expected > 0, F.col("__v") / expected).otherwise(1.0)
    wrong = dims.withColumn("__e", expected).where(~share.between(0.95, 1.05) & (F.col("__v") != F.rint(expected)))
    return _rows(_first(wrong, most), "dimension_scale_mismatch", F.col("ord"), F.format_string("%.2f vs %.2f", "__v", "__e"))


def no_tolerances(e: DataFrame) -> DataFrame:
    """Sheets that declare no general tolerance; a declaration may run over up to three texts, one after the other."""
    texts = e.where(said() != "").withColumn("__t", F.lower(said()))
    w = Window.partitionBy("sheet").orderBy("ord")
    joined = F.concat_ws(" ", "__t", F.lead("__t", 1).over(w), F.lead("__t", 2).over(w))
    has = texts.withColumn("__j", joined).where(_any(TOLERANCES, F.col("__j"))).select("sheet").distinct()
    return _rows(e.select("sheet").distinct().join(has, "sheet", "left_anti"), "missing_tolerances", F.col("sheet"), F.lit("missing"))


def title_placeholders(e: DataFrame) -> DataFrame:
    """Texts on title layers that are empty or hold a placeholder."""
    bad = (said() == "") | _any(PLACEHOLDERS, F.lower(said()))
    return _rows(e.where((F.col("kind") == "text") & bad & F.lower("layer").isin(TITLE_LAYERS)), "empty_title_block", F.col("ord"), said())


def blank_attributes(e: DataFrame) -> DataFrame:
    """Attributes of blocks on title layers that are there and blank; null ones aren't there."""
    held = e.where((F.col("kind") == "block") & F.lower("layer").isin(TITLE_LAYERS)).select("sheet", "ord", F.explode("attributes").alias("tag", "value"))
    return _rows(held.where(F.col("value").isNotNull() & (F.btrim("value") == "")), "empty_block_attribute", F.col("ord"), F.col("tag"))


def orphan_texts(e: DataFrame) -> DataFrame:
    """Texts without any."""
    return _rows(e.where((F.col("kind") == "text") & (said() == "")), "orphan_annotation", F.col("ord"), F.lit(""))


def malformed_frames(e: DataFrame) -> DataFrame:
    """Tolerance frames with a content that has neither a sign nor the form of one."""
    bad = (said() != "") & ~_any(FRAME_SIGNS, said()) & ~said().rlike(FRAME)
    return _rows(e.where((F.col("kind") == "tolerance") & bad), "malformed_gdt_frame", F.col("ord"), said())


def odd_heights(e: DataFrame, most: int = 3) -> DataFrame:
    """Heights (2.5 where unknown) of texts of model space, which is the default, not within 0.1 of a standard one; the first three of a sheet."""
    h = F.coalesce(F.col("height").cast("double"), F.lit(2.5))
    near = F.lit(False)
    for s in HEIGHTS:
        near |= F.abs(h - s) < 0.1
    texts = e.where((F.col("kind") == "text") & (F.lower(F.coalesce("space", F.lit("model"))) == "model") & ~near).withColumn("__h", h)
    return _rows(_first(texts, most), "non_standard_text_height", F.col("ord"), F.format_string("%.2f", "__h"))


def no_centre_lines(e: DataFrame) -> DataFrame:
    """Circles of a radius over 2, and nothing on a layer of centre lines."""
    return _sheets(e, "missing_center_lines", (F.col("large") > 0) & (F.col("centre") == 0), F.col("large"), large=(F.col("kind") == "circle") & (F.col("radius") > 2.0), centre=F.contains(F.lower("layer"), F.lit("center")))


def no_projection(e: DataFrame) -> DataFrame:
    """No text says which projection is used."""
    return _sheets(e, "missing_projection_type", F.col("noted") == 0, F.lit("missing"), noted=_any(["projection", "angle"], F.lower(said())) | F.contains(said(), F.lit("角法")))


def unclear_threads(e: DataFrame) -> DataFrame:
    """Every thread in a text of four characters at most, whole words of M and a number in either case."""
    held = e.where((said() != "") & (F.char_length(said()) <= 4)).select("sheet", "ord", F.explode(F.regexp_extract_all(said(), F.lit(THREAD), F.lit(1))).alias("__t"))
    return _rows(held, "unclear_thread_specification", F.col("ord"), F.upper("__t"))


def no_revision_clouds(e: DataFrame, lowered: bool = True) -> DataFrame:
    """A revision B to Z is named and no layer is of revisions or clouds. The rule as it has always run looks for capitals in lower-cased texts and so never fires; ``lowered`` false makes it look at the texts as they are, in either case."""
    named = F.lower(said()).rlike("rev\\s*[B-Z]") if lowered else said().rlike("(?i)rev\\s*[B-Z]")
    return _sheets(e, "missing_revision_clouds", (F.col("named") > 0) & (F.col("clouds") == 0), F.col("named"), named=named, clouds=_any(["rev", "cloud"], F.lower("layer")))


def no_roughness(e: DataFrame) -> DataFrame:
    """A fit H6 to H8 is asked for and no text speaks of roughness."""
    rough = _any(ROUGHNESS, F.lower(said())) | F.contains(said(), F.lit("仕上げ"))
    return _sheets(e, "missing_surface_roughness", (F.col("tight") > 0) & (F.col("rough") == 0), F.col("tight"), tight=said().rlike(r"(?U)\b[Hh][6-8]\b"), rough=rough)


def unknown_units(sheets: DataFrame) -> DataFrame:
    """Sheets (sheet, measurement) without a known system of measures: none, or -1."""
    return _rows(sheets.where(F.coalesce("measurement", F.lit(-1)) == -1), "unsupported_units", F.col("sheet"), F.lit("-1"))
