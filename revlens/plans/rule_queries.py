"""Each drafting rule on sheets made of the lines of a part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import sheet_rules as R

from .base import Book, Tables
from .sheet_queries import sql_list

book = Book()

TEXTS = [
    "Scale 1:20", "SCALE : 20 : 1", "scale 1/2", "scale 3 / 4", "ISO 2768", "general", "tolerance", "first angle", "角法", "M12", "m 8", "M12x1.75", "xM12", "M5.", "rev B", "bore H7", "h6", "Ra 3.2", "仕上げ", "frame", "N/A", "see xxxx", "   ",
    "designer", "plain", "Insert here", "20", "H9", "R", "",
]
LAYERS = ["0", "AM_0", "Title", "border", "AM_BOR", "temp_1", "Center", "WAKU", "rev cloud", "Defpoints", "mywork", "am_dim", "0", "0"]
FRAMES = ["⌖ 0.1", "|0.1|A|", "0.1 A", "", "|0.05 ⌀|B C"]
SQL_BASE = f"""
WITH e AS (
  SELECT l_partkey AS sheet, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS ord, h, CASE WHEN h < 40 THEN 'text' WHEN h < 60 THEN 'line' WHEN h < 75 THEN 'circle' WHEN h < 85 THEN 'dimension' WHEN h < 92 THEN 'block' WHEN h < 96 THEN 'tolerance' ELSE 'polyline' END AS kind,
         ({sql_list(LAYERS)})[(l_orderkey * 3 + l_suppkey) % {len(LAYERS)} + 1] AS layer,
         CASE WHEN h < 40 THEN ({sql_list(TEXTS)})[(l_orderkey * 13 + l_suppkey) % {len(TEXTS)} + 1] WHEN h BETWEEN 75 AND 84 THEN CASE l_orderkey % 4 WHEN 0 THEN '%%c' || l_quantity::INT WHEN 1 THEN (l_quantity::INT + 3)::VARCHAR WHEN 2 THEN '1.2.3' END
              WHEN h BETWEEN 92 AND 95 THEN ({sql_list(FRAMES)})[l_orderkey % {len(FRAMES)} + 1] END AS text,
         CASE WHEN h BETWEEN 40 AND 59 THEN (l_suppkey % 3)::DOUBLE END AS x1, (l_orderkey % 3)::DOUBLE AS y1, CASE WHEN h BETWEEN 40 AND 59 THEN (l_orderkey % 2)::DOUBLE END AS x2, (l_suppkey % 2)::DOUBLE AS y2,
         l_linenumber::DOUBLE AS radius, CASE WHEN l_linenumber < 6 THEN l_linenumber + 0.55::DOUBLE END AS height, CASE l_suppkey % 4 WHEN 0 THEN 'PAPER' WHEN 1 THEN 'Model' END AS space, CASE WHEN h BETWEEN 75 AND 84 THEN l_quantity END AS measurement
  FROM (SELECT *, (l_orderkey * 31 + l_linenumber * 17 + l_suppkey * 7) % 100 AS h FROM lineitem)
), t AS (SELECT *, coalesce(trim(text), '') AS said, lower(coalesce(trim(text), '')) AS low, lower(layer) AS lay FROM e) """


def entities(spark, sf_dir: str) -> DataFrame:
    """Sheets of the lines of each part, of the kinds that rules speak of."""
    line = Tables(spark, sf_dir).lineitem
    o, s, n, q = (F.col(c) for c in ("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity"))
    h = (o * 31 + n * 17 + s * 7) % 100
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    kind = F.when(h < 40, "text").when(h < 60, "line").when(h < 75, "circle").when(h < 85, "dimension").when(h < 92, "block").when(h < 96, "tolerance").otherwise("polyline")
    value = F.when(o % 4 == 0, F.concat(F.lit("%%c"), q.cast("int"))).when(o % 4 == 1, (q.cast("int") + 3).cast("string")).when(o % 4 == 2, "1.2.3")
    text = F.when(h < 40, pick(TEXTS, (o * 13 + s) % len(TEXTS))).when(h.between(75, 84), value).when(h.between(92, 95), pick(FRAMES, o % len(FRAMES)))
    attributes = F.create_map(F.lit("NO"), F.when(n % 2 == 0, F.lit(" ")), F.lit("NAME"), F.when(s % 3 == 0, F.lit("")).otherwise(F.lit("x")))
    return line.select(
        F.col("l_partkey").alias("sheet"), ((o * 10 + n) * 100000 + s).alias("ord"), kind.alias("kind"), pick(LAYERS, (o * 3 + s) % len(LAYERS)).alias("layer"), text.alias("text"),
        F.when(h.between(40, 59), (s % 3).cast("double")).alias("x1"), (o % 3).cast("double").alias("y1"), F.when(h.between(40, 59), (o % 2).cast("double")).alias("x2"), (s % 2).cast("double").alias("y2"),
        n.cast("double").alias("radius"), F.when(n < 6, n + 0.55).cast("double").alias("height"), F.when(s % 4 == 0, "PAPER").when(s % 4 == 1, "Model").alias("space"), F.when(h.between(75, 84), q).alias("measurement"), attributes.alias("attributes"),
    )


def has(column: str, values) -> str:
    return "(" + " OR ".join("contains(" + column + ", '" + v.replace("'", "''") + "')" for v in values) + ")"


def whole(rule: str, detail: str, having: str) -> str:
    return f"{SQL_BASE} SELECT sheet, '{rule}' AS rule, sheet::VARCHAR AS subject, ({detail})::VARCHAR AS detail FROM t GROUP BY sheet HAVING {having}"


def each(rule: str, detail: str, where: str, most: int | None = None) -> str:
    rows = f"SELECT sheet, '{rule}' AS rule, ord::VARCHAR AS subject, ({detail})::VARCHAR AS detail FROM t WHERE {where}"
    return f"{SQL_BASE} {rows}" + (f" QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY ord) <= {most}" if most else "")


SCALE = r"(?i)scale\s*:?\s*(\d+)\s*[:/]\s*(\d+)"
RULES = {
    "r01_forbidden_layers": (R.forbidden_layers, each("forbidden_layer_name", "layer", has("lay", R.FORBIDDEN))),
    "r01_unknown_layers": (R.unknown_layers, f"{SQL_BASE} SELECT DISTINCT sheet, 'invalid_layer' AS rule, layer AS subject, layer AS detail FROM t WHERE NOT list_contains({sql_list(R.LAYERS)}, lay) AND NOT {has('lay', R.FORBIDDEN)}"),
    "r02_duplicate_lines": (R.duplicate_lines, f"""{SQL_BASE}, d AS (
        SELECT *, row_number() OVER (PARTITION BY sheet, least((x1, y1), (x2, y2)), greatest((x1, y1), (x2, y2)) ORDER BY ord) AS k FROM t WHERE kind = 'line')
        SELECT sheet, 'duplicate_entities' AS rule, ord::VARCHAR AS subject, printf('%.1f %.1f %.1f %.1f', x1, y1, x2, y2) AS detail FROM d WHERE k > 1 QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY ord) <= 5"""),
    "r03_few_dimensions": (R.few_dimensions, whole("missing_dimensions", "count(*) FILTER (WHERE kind IN ('line', 'circle', 'arc', 'polyline')) || '/' || count(*) FILTER (WHERE kind = 'dimension')", "count(*) FILTER (WHERE kind IN ('line', 'circle', 'arc', 'polyline')) > 10 AND count(*) FILTER (WHERE kind = 'dimension') < 2")),
    "r04_odd_scales": (R.odd_scales, each("invalid_scale", rf"regexp_extract(said, '{SCALE}', 1) || ':' || regexp_extract(said, '{SCALE}', 2)", rf"kind = 'text' AND regexp_matches(said, '{SCALE}') AND NOT list_contains({sql_list(R.SCALES)}, regexp_extract(said, '{SCALE}', 1) || ':' || regexp_extract(said, '{SCALE}', 2))")),
    "r05_off_dimensions": (R.off_dimensions, f"""{SQL_BASE}, s AS (SELECT sheet, arg_min(regexp_extract(said, '{SCALE}', 1)::DOUBLE / regexp_extract(said, '{SCALE}', 2)::DOUBLE, ord) AS scale FROM t WHERE regexp_matches(said, '{SCALE}') GROUP BY sheet),
        d AS (SELECT t.sheet, ord, try_cast(regexp_replace(said, '[^\\d.]', '', 'g') AS DOUBLE) AS v, measurement * coalesce(scale, 1) AS e FROM t LEFT JOIN s ON t.sheet = s.sheet WHERE kind = 'dimension')
        SELECT sheet, 'dimension_scale_mismatch' AS rule, ord::VARCHAR AS subject, printf('%.2f vs %.2f', v, e) AS detail FROM d WHERE v > 0 AND e > 0 AND NOT v / e BETWEEN 0.95 AND 1.05 AND v <> round_even(e, 0) QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY ord) <= 2"""),
    "r06_no_tolerances": (R.no_tolerances, f"""{SQL_BASE}, j AS (SELECT sheet, concat_ws(' ', low, lead(low, 1) OVER w, lead(low, 2) OVER w) AS j FROM t WHERE said <> '' WINDOW w AS (PARTITION BY sheet ORDER BY ord))
        SELECT DISTINCT sheet, 'missing_tolerances' AS rule, sheet::VARCHAR AS subject, 'missing' AS detail FROM t WHERE sheet NOT IN (SELECT sheet FROM j WHERE {has("j", R.TOLERANCES)})"""),
    "r07_title_placeholders": (R.title_placeholders, each("empty_title_block", "said", f"kind = 'text' AND (said = '' OR {has('low', R.PLACEHOLDERS)}) AND list_contains({sql_list(R.TITLE_LAYERS)}, lay)")),
    "r09_blank_attributes": (R.blank_attributes, f"""{SQL_BASE} SELECT sheet, 'empty_block_attribute' AS rule, ord::VARCHAR AS subject, tag AS detail FROM (
        SELECT t.sheet, t.ord, tag, CASE tag WHEN 'NO' THEN CASE WHEN radius % 2 = 0 THEN ' ' END ELSE CASE WHEN ord % 100000 % 3 = 0 THEN '' ELSE 'x' END END AS value FROM t, (VALUES ('NO'), ('NAME')) AS a(tag) WHERE kind = 'block' AND list_contains({sql_list(R.TITLE_LAYERS)}, lay)) WHERE trim(value) = ''"""),
    "r10_orphan_texts": (R.orphan_texts, each("orphan_annotation", "''", "kind = 'text' AND said = ''")),
    "r11_malformed_frames": (R.malformed_frames, each("malformed_gdt_frame", "said", f"kind = 'tolerance' AND said <> '' AND NOT {has('said', R.FRAME_SIGNS)} AND NOT regexp_matches(said, '{R.FRAME}')")),
    "r13_odd_heights": (R.odd_heights, each("non_standard_text_height", "printf('%.2f', coalesce(height, 2.5))", f"kind = 'text' AND lower(coalesce(space, 'model')) = 'model' AND len(list_filter({R.HEIGHTS}, lambda s: abs(coalesce(height, 2.5) - s) < 0.1)) = 0", 3)),
    "r14_no_centre_lines": (R.no_centre_lines, whole("missing_center_lines", "count(*) FILTER (WHERE kind = 'circle' AND radius > 2)", "count(*) FILTER (WHERE kind = 'circle' AND radius > 2) > 0 AND NOT bool_or(contains(lay, 'center'))")),
    "r15_no_projection": (R.no_projection, whole("missing_projection_type", "'missing'", "NOT bool_or(contains(low, 'projection') OR contains(low, 'angle') OR contains(said, '角法'))")),
    "r16_unclear_threads": (R.unclear_threads, rf"""{SQL_BASE} SELECT sheet, 'unclear_thread_specification' AS rule, ord::VARCHAR AS subject, upper(unnest(regexp_extract_all(said, '(?i)\b(M\s*\d+)\b', 1))) AS detail FROM t WHERE said <> '' AND length(said) <= 4"""),
    "r17_no_revision_clouds": (lambda e: R.no_revision_clouds(e, lowered=False), whole("missing_revision_clouds", r"count(*) FILTER (WHERE regexp_matches(said, '(?i)rev\s*[B-Z]'))", r"bool_or(regexp_matches(said, '(?i)rev\s*[B-Z]')) AND NOT bool_or(contains(lay, 'rev') OR contains(lay, 'cloud'))")),
    "r18_no_roughness": (R.no_roughness, whole("missing_surface_roughness", r"count(*) FILTER (WHERE regexp_matches(said, '\b[Hh][6-8]\b'))", rf"bool_or(regexp_matches(said, '\b[Hh][6-8]\b')) AND NOT bool_or({has('low', R.ROUGHNESS)} OR contains(said, '仕上げ'))")),
}


def _register(name: str, rule, sql: str) -> None:
    def query(spark, sf_dir):
        return rule(entities(spark, sf_dir))

    query.__name__, query.__doc__ = name, rule.__doc__
    book.add(sql)(query)


for _name, (_rule, _sql) in RULES.items():
    _register(_name, _rule, _sql)


@book.add("SELECT p_partkey AS sheet, 'unsupported_units' AS rule, p_partkey::VARCHAR AS subject, '-1' AS detail FROM part WHERE p_size % 5 < 2")
def r19_unknown_units(spark, sf_dir):
    size = F.col("p_size")
    return R.unknown_units(Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("sheet"), F.when(size % 5 == 0, -1).when(size % 5 > 1, 1).alias("measurement")))
