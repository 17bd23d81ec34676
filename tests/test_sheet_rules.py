"""Each drafting rule on hand-made entities with rows written by hand."""

import pytest
from pyspark.sql import functions as F

from revlens.operators import sheet_rules as R

COLS = "sheet long, ord long, kind string, layer string, text string, x1 double, y1 double, x2 double, y2 double, radius double, height double, space string, measurement double, attributes map<string,string>"


def e(ord_, kind, layer="0", text=None, line=(None,) * 4, radius=None, height=None, space=None, measurement=None, attributes=None, sheet=1):
    return (sheet, ord_, kind, layer, text, *line, radius, height, space, measurement, attributes)


def t(ord_, text, layer="0", sheet=1, **more):
    return e(ord_, "text", layer, text, sheet=sheet, **more)


CASES = {
    "forbidden_layers": (R.forbidden_layers, [e(1, "line", "Temp"), e(2, "text", "mywork2"), e(3, "line", "0"), e(4, "line", None), e(5, "line", "temp")], {(1, "1", "Temp"), (1, "2", "mywork2"), (1, "5", "temp")}),
    "unknown_layers": (R.unknown_layers, [e(1, "line", "WAKU"), e(2, "line", "WAKU"), e(3, "line", "waku"), e(4, "line", "AM_BOR"), e(5, "line", "junk"), e(6, "line", "WAKU", sheet=2)], {(1, "WAKU", "WAKU"), (1, "waku", "waku"), (2, "WAKU", "WAKU")}),
    "duplicate_lines": (R.duplicate_lines, [e(1, "line", line=(0.0, 0.0, 1.0, 2.0)), e(2, "line", line=(1.0, 2.0, 0.0, 0.0)), e(3, "line", line=(0.0, 0.0, 1.0, 2.1)), e(4, "line"), e(5, "line")] + [e(10 + k, "line", line=(5.0, 5.0, 6.0, 6.0), sheet=2) for k in range(9)],
        {(1, "2", "1.0 2.0 0.0 0.0")} | {(2, str(11 + k), "5.0 5.0 6.0 6.0") for k in range(5)}),
    "few_dimensions": (R.few_dimensions, [e(k, "line") for k in range(9)] + [e(20, "arc"), e(21, "circle"), e(22, "dimension")] + [e(k, "polyline", sheet=2) for k in range(10)] + [e(k, "line", sheet=3) for k in range(12)] + [e(30, "dimension", sheet=3), e(31, "dimension", sheet=3)], {(1, "1", "11/1")}),
    "odd_scales": (R.odd_scales, [t(1, "SCALE 20:1"), t(2, "scale 1:50"), t(3, "Scale : 1 / 3"), t(4, "scale 1/2"), t(5, "50:1"), t(6, None), e(7, "mtext", text="scale 7:1"), t(8, "scale50:1")], {(1, "1", "20:1"), (1, "3", "1:3"), (1, "8", "50:1")}),
    "off_dimensions": (R.off_dimensions, [t(1, "scale 1:0"), t(2, "Scale 1:2"), t(3, "scale 5:1")] + [e(k, "dimension", text=x, measurement=m) for k, x, m in ((4, "%%c50", 100.0), (5, "100", 100.0), (6, "13", 25.4), (7, "0", 9.0), (8, "1.2.3", 9.0), (9, "x60", 100.0), (10, "90", 100.0), (11, None, 3.0), (12, "9", None))]
        + [e(1, "dimension", text="12", measurement=12.5, sheet=2), e(2, "dimension", text="13.2", measurement=12.5, sheet=2)], {(1, "5", "100.00 vs 50.00"), (1, "9", "60.00 vs 50.00"), (2, "2", "13.20 vs 12.50")}),
    "no_tolerances": (R.no_tolerances, [t(1, "see ISO 2768-m"), t(1, "General", sheet=2), t(2, "Tolerance", sheet=2), t(1, "JIS", sheet=3), t(2, "B", sheet=3), t(3, "0405", sheet=3), t(1, "general", sheet=4), t(2, "x", sheet=4), t(3, "tolerance", sheet=4), e(1, "line", sheet=5)], {(4, "4", "missing"), (5, "5", "missing")}),
    "title_placeholders": (R.title_placeholders, [t(1, "N/A", "Title"), t(2, " ", "AM_BOR"), t(3, "the Designer is", "border"), t(4, "TBD", "title"), t(5, "N/A", "0"), t(6, "xxx", "title"), t(7, "----", "title_block")], {(1, "1", "N/A"), (1, "2", ""), (1, "3", "the Designer is"), (1, "7", "----")}),
    "blank_attributes": (R.blank_attributes, [e(1, "block", "title", attributes={"A": " ", "B": None, "C": "x", "D": ""}), e(2, "block", "0", attributes={"A": ""}), e(3, "block", "title"), e(4, "text", "title", attributes={"A": ""})], {(1, "1", "A"), (1, "1", "D")}),
    "orphan_texts": (R.orphan_texts, [t(1, None), t(2, "  "), t(3, "x"), e(4, "mtext", text="")], {(1, "1", ""), (1, "2", "")}),
    "malformed_frames": (R.malformed_frames, [e(1, "tolerance", text="0.1 A"), e(2, "tolerance", text="⌖ 0.1"), e(3, "tolerance", text="|0.1|A|"), e(4, "tolerance", text=""), e(5, "text", text="0.1 A"), e(6, "tolerance", text="||A")], {(1, "1", "0.1 A"), (1, "6", "||A")}),
    "odd_heights": (R.odd_heights, [t(1, "a", height=3.0), t(2, "b", height=2.55), t(3, "c"), t(4, "d", height=4.0, space="PAPER"), t(5, "e", height=6.0, space="Model"), t(6, "f", height=6.0), t(7, "g", height=6.0), e(8, "mtext", height=6.0)], {(1, "1", "3.00"), (1, "5", "6.00"), (1, "6", "6.00")}),
    "no_centre_lines": (R.no_centre_lines, [e(1, "circle", radius=2.1), e(2, "circle", radius=2.0), e(1, "circle", radius=9.0, sheet=2), e(2, "line", "CenterLine", sheet=2), e(1, "circle", radius=1.0, sheet=3), e(1, "arc", radius=9.0, sheet=4)], {(1, "1", "1")}),
    "no_projection": (R.no_projection, [t(1, "Third ANGLE"), t(1, "第三角法", sheet=2), t(1, "x", sheet=3), e(1, "line", sheet=4), t(1, "rectangle", sheet=5)], {(3, "3", "missing"), (4, "4", "missing")}),
    "unclear_threads": (R.unclear_threads, [t(1, "M12"), t(2, "m 8"), t(3, "xM12"), t(4, "M12x"), t(5, "M1M2"), t(6, "M12 THRU"), t(7, " M5 "), t(8, "M3 M"), e(9, "mtext", text="M6")], {(1, "1", "M12"), (1, "2", "M 8"), (1, "7", "M5"), (1, "8", "M3"), (1, "9", "M6")}),
    "no_revision_clouds as it runs": (R.no_revision_clouds, [t(1, "REV B"), t(2, "rev b")], set()),
    "no_revision_clouds": (lambda d: R.no_revision_clouds(d, lowered=False), [t(1, "REV B"), t(2, "rev c"), t(3, "rev A"), t(1, "rev B", sheet=2), e(2, "line", "Cloud", sheet=2), t(1, "rev A", sheet=3)], {(1, "1", "2")}),
    "no_roughness": (R.no_roughness, [t(1, "bore H7"), t(2, "xH7"), t(1, "h6", sheet=2), t(2, "Ra 3.2", sheet=2), t(1, "H8", sheet=3), t(2, "仕上げ", sheet=3), t(1, "H9", sheet=4)], {(1, "1", "1")}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    rule, rows, want = CASES[name]
    df = spark.createDataFrame(rows, COLS).withColumn("detail", F.lit("clash")).withColumn("tag", F.lit("clash")).repartition(2)
    got = [(r.sheet, r.subject, r.detail) for r in rule(df).collect()]
    assert sorted(got) == sorted(want) and rule(df).columns == ["sheet", "rule", "subject", "detail"]
    assert rule(df.where("false")).count() == 0


def test_units(spark):
    df = spark.createDataFrame([(1, -1), (2, None), (3, 0), (4, 1)], "sheet long, measurement int")
    assert {r.sheet for r in R.unknown_units(df).collect()} == {1, 2}
