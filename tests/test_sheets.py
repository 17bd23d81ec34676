"""Blocks, zones, notes, title blocks and tables of sheets against plain loops and hand-made fixtures."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from revlens import catalog
from revlens.operators import blocks, folds, notes, tables, titles, zones
from revlens.plans import sheet_queries

FOLDER = "/root/testdata/sf0.001"
ENTITY = "sheet long, ord long, kind string, text string, x double, y double, height double, path array<struct<x:double,y:double>>, parent string"


def entity(sheet, ord_, kind, text=None, x=None, y=None, path=None, parent=None, height=None):
    return (sheet, ord_, kind, text, x, y, height, path, parent)


# -- blocks


def plain_explode(block, defs, transform, depth=0, nested=True):
    """[(path, kind, points moved, radius)] by recursion."""
    if depth > 10:
        return []
    out = []
    for d in [d for d in defs if d["block"] == block]:
        if d["kind"] == "insert":
            own = placed_as(d)
            step = (lambda p, o=own: transform(o(p))) if nested else own
            step.scale = (transform.scale if nested else 1.0) * own.scale
            out += [([d["ord"], *path], *rest) for path, *rest in plain_explode(d["child"], defs, step, depth + 1, nested)]
        else:
            at = transform((d["x1"], d["y1"])) if d["kind"] != "text" else (d["x1"], d["y1"])
            out.append(([d["ord"]], d["kind"], at, (d["r"] if d["r"] is not None else 1.0) * transform.scale if d["kind"] == "circle" else d["r"]))
    return out


def placed_as(d):
    sx, sy, t = d["scale_x"] or 1.0, d["scale_y"] or 1.0, math.radians(d["turn"] or 0.0)

    def apply(p):
        x, y = p[0] * sx, p[1] * sy
        return x * math.cos(t) - y * math.sin(t) + (d["at_x"] or 0.0), x * math.sin(t) + y * math.cos(t) + (d["at_y"] or 0.0)

    apply.scale = sx
    return apply


DEF = "block string, ord long, kind string, child string, x1 double, y1 double, x2 double, y2 double, r double, text string, at_x double, at_y double, turn double, scale_x double, scale_y double"


@pytest.mark.parametrize("nested", [True, False])
def test_explosion_composes_and_a_cycle_ends(spark, nested):
    thing = lambda block, ord_, kind, x, y, r=None: (block, ord_, kind, None, x, y, x, y, r, None, None, None, None, None, None)
    place = lambda block, ord_, child, x, y, turn=None, sx=None, sy=None: (block, ord_, "insert", child, None, None, None, None, None, None, x, y, turn, sx, sy)
    rows = [
        thing("leaf", 1, "line", 1.0, 2.0), thing("leaf", 2, "circle", 3.0, 0.0, 2.0), thing("leaf", 3, "circle", 3.0, 1.0), thing("leaf", 4, "text", 9.0, 9.0), thing("leaf", 5, "line", None, 1.0),
        place("mid", 1, "leaf", 10.0, 0.0, 90.0, 2.0, 3.0), thing("mid", 2, "line", 1.0, 1.0), place("mid", 3, "nowhere", 0.0, 0.0), place("mid", 4, None, 0.0, 0.0),
        place("top", 1, "mid", 0.0, 5.0, 30.0), place("top", 2, "leaf", None, None, None, -1.0), place("loop", 1, "loop", 1.0, 0.0), thing("loop", 2, "line", 0.0, 0.0),
    ]
    defs = spark.createDataFrame(rows, DEF)
    names = [f.split()[0] for f in DEF.split(", ")]
    plain = [dict(zip(names, r, strict=True)) for r in rows if r[2] == "insert" or r[4] is not None]
    places = [(1, "top", 100.0, 0.0, 45.0, 2.0, None), (2, "mid", 0.0, 0.0, None, None, None), (3, "loop", 0.0, 0.0, 0.0, 1.0, 1.0), (4, "gone", 0.0, 0.0, 0.0, 1.0, 1.0), (5, None, 0.0, 0.0, 0.0, 1.0, 1.0), (2, "mid", 0.0, 0.0, None, None, None)]
    got = blocks.exploded(spark.createDataFrame(places, "id long, block string, at_x double, at_y double, turn double, scale_x double, scale_y double"), defs, "id", nested=nested).collect()
    want = []
    for id_, block, *p in places:
        transform = placed_as(dict(zip(("at_x", "at_y", "turn", "scale_x", "scale_y"), p, strict=True)))
        want += [(id_, tuple(path), kind, round(x, 6) + 0.0, round(y, 6) + 0.0, r) for path, kind, (x, y), r in plain_explode(block, plain, transform, nested=nested)]
    assert sorted((r.id, tuple(r.path), r.kind, round(r.x1, 6) + 0.0, round(r.y1, 6) + 0.0, r.r) for r in got) == sorted(want)
    assert sum(r.id == 3 for r in got) == 11 and not any(r.id > 3 for r in got)
    if nested:
        assert max(r.x1 for r in got if r.id == 3) == 10.0  # ten placements under the first


def test_no_definitions(spark):
    nothing = spark.createDataFrame([], DEF)
    places = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.0, 1.0, 1.0)], "id long, block string, at_x double, at_y double, turn double, scale_x double, scale_y double")
    assert blocks.exploded(places, nothing, "id").count() == 0


# -- growth and zones


def plain_growth(points, box, rx, ry, w, h):
    x0, y0, x1, y1 = box
    changed = True
    while changed:
        changed = False
        for x, y in points:
            if x0 - rx <= x <= x1 + rx and y0 - ry <= y <= y1 + ry:
                new = min(x0, x), min(y0, y), max(x1, x), max(y1, y)
                if new[2] - new[0] <= w and new[3] - new[1] <= h and new != (x0, y0, x1, y1):
                    (x0, y0, x1, y1), changed = new, True
    return x0, y0, x1, y1


def test_boxes_grow_as_in_a_loop(spark):
    rng = random.Random(1)
    points, seeds, want = [], [], {}
    for sheet in range(12):
        own = [(k // 2, k % 2, round(rng.uniform(0, 100), 2), round(rng.uniform(0, 100), 2), rng.random() < 0.4) for k in range(rng.choice([0, 3, 40, 400]))]
        points += [(sheet, *p) for p in own]
        for zone, rx, ry, w, h, lines in (("a", 4.0, 3.0, 60.0, 50.0, True), ("b", 30.0, 9.0, 25.0, 90.0, False), ("c", 5.0, 5.0, 1e6, 1e6, True)):
            x, y = rng.uniform(20, 80), rng.uniform(20, 80)
            seeds.append((sheet, zone, x, y, x + 2, y, rx, ry, w, h, lines))
            want[sheet, zone] = plain_growth([p[2:4] for p in sorted(own) if lines or not p[4]], (x, y, x + 2, y), rx, ry, w, h)
    s = spark.createDataFrame(seeds, "sheet long, zone string, xmin double, ymin double, xmax double, ymax double, reach_x double, reach_y double, most_w double, most_h double, lines boolean")
    p = spark.createDataFrame(points, "sheet long, ord long, part int, x double, y double, line boolean").repartition(3)
    got = {(r.sheet, r.zone): (r.xmin, r.ymin, r.xmax, r.ymax) for r in zones.grown_boxes(s, p).collect()}
    assert got == want


def plain_zones(rows):
    """{zone: (box, anchors)} of one sheet's entities in order."""
    fold = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").strip().lower())
    drawn = [p for r in rows if r["kind"] in ("line", "polyline") and r["path"] and len(r["path"]) >= 2 for p in r["path"]]
    b = (min(p[0] for p in drawn), min(p[1] for p in drawn), max(p[0] for p in drawn), max(p[1] for p in drawn)) if drawn else None
    x0, y0, x1, y1 = b or (0.0, 0.0, 1000.0, 1000.0)
    w, h = x1 - x0 if x1 > x0 else 1000.0, y1 - y0 if y1 > y0 else 1000.0

    def grid(r):
        if not b or b[2] <= b[0] or b[3] <= b[1] or r["kind"] not in zones.TEXTS or r["x"] is None:
            return False
        t = unicodedata.normalize("NFKC", (r["text"] or "").strip())
        label = t in list("ABCDEFGH") or (t.isdigit() and 1 <= int(t) <= 12) or any(c in (r["text"] or "") for c in "①②③④⑤⑥⑦⑧⑨⑩⑪⑫")
        mx, my = (b[2] - b[0]) * 0.09, (b[3] - b[1]) * 0.09
        return label and (r["x"] < b[0] + mx or r["x"] > b[2] - mx or r["y"] < b[1] + my or r["y"] > b[3] - my)

    rows = [r for r in rows if not grid(r)]
    out = {}
    for zone, phrases in zones.ANCHORS.items():
        hits = []
        for r in rows:
            if r["kind"] in zones.TEXTS and r["text"] and r["x"] is not None:
                first = next((p for p in phrases if p in fold(r["text"])), None)
                fx, fy = (r["x"] - x0) / w, (r["y"] - y0) / h
                ok = {"title_upper_left": fx < 0.45 and fy > 0.5, "title": fx > 0.45 and fy < 0.45, "tolerance": fy < 0.45, "bom": fx > 0.5 and fy > 0.35, "iso": fx > 0.3, "notes": fy > 0.15}
                if first and ok.get(zone, True):
                    hits.append((r["x"], r["y"], first))
        if not hits:
            continue
        reach = {
            "title_upper_left": (max(80, w * 0.2), max(35, h * 0.08)), "bom": (max(50, w * 0.15), max(15, h * 0.04)), "tolerance": (max(50, w * 0.15), max(12, h * 0.03)),
            "notes": (max(15, h * 0.03),) * 2, "shim": (max(20, h * 0.05),) * 2,
        }.get(zone, (200.0, 200.0))
        alone = zone in zones.NO_LINES
        points = []
        for r in rows:
            if r["kind"] in zones.TEXTS and r["x"] is not None:
                points.append((r["x"], r["y"]))
            elif r["kind"] == "line" and not alone:
                points += r["path"][:2]
        mw, mh = w * zones.LIMITS[zone][0], h * zones.LIMITS[zone][1]
        box = plain_growth(points, (min(p[0] for p in hits), min(p[1] for p in hits), max(p[0] for p in hits), max(p[1] for p in hits)), *reach, mw, mh)
        pad = 5.0 if alone else 30.0
        box = plain_clamp((box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad), mw, mh)
        bw, bh = box[2] - box[0], box[3] - box[1]
        valid = (bw >= 10 or bw >= w * 0.005) and (bh >= 10 or bh >= h * 0.005) if zone in ("title_upper_left", "notes") else bw >= w * 0.03 and bh >= h * 0.03
        anchors = sorted({p[2] for p in hits})
        if valid:
            out[zone] = box, anchors
        elif zone == "iso":
            out["iso anchors"] = None, anchors
    ellipses = [r for r in rows if r["kind"] == "ellipse"]
    members = []
    if len(ellipses) >= 3:
        held = {}
        for r in ellipses:
            if r["parent"]:
                held[r["parent"]] = held.get(r["parent"], 0) + 1
        top = max(held, key=held.get) if held else None
        if top and held[top] >= 0.6 * len(ellipses):
            members = [r for r in rows if r["parent"] == top]
        else:
            reach = math.hypot(b[2] - b[0], b[3] - b[1]) * 0.15 if b else 200.0
            groups, left = [], list(ellipses)
            while left:
                group = [left.pop(0)]
                for g in group:
                    near = [r for r in left if math.hypot(r["x"] - g["x"], r["y"] - g["y"]) <= reach]
                    group += near
                    left = [r for r in left if r not in near]
                groups.append(group)
            best = max(groups, key=len)
            members = best if len(best) >= 3 else []
    points = [p for r in members for p in [(r["x"], r["y"]), *(r["path"] or [])] if p[0] is not None]
    if len(points) >= 4:
        box = (min(p[0] for p in points) - 30, min(p[1] for p in points) - 30, max(p[0] for p in points) + 30, max(p[1] for p in points) + 30)
        out["iso"] = plain_clamp(box, w * 0.45, h * 0.45), out.get("iso", out.get("iso anchors", (None, [])))[1]
    out.pop("iso anchors", None)
    if b:
        out["views"] = b, []
    return out


def plain_clamp(box, w, h):
    x0, y0, x1, y1 = box
    ex, ey = max(0.0, (x1 - x0 - w) / 2), max(0.0, (y1 - y0 - h) / 2)
    return x0 + ex, y0 + ey, x1 - ex, y1 - ey


def test_zones_as_in_a_loop(spark):
    rng = random.Random(2)
    texts = [p for ps in zones.ANCHORS.values() for p in ps[:3]] + ["Ａ", "3", "⑦", "words", "ＮＯＴＥ:", "", None, "  Part   No. 7"]
    rows = []
    for sheet in range(9):
        size = [400.0, 1200.0, 60.0][sheet % 3]
        spot = lambda size=size: (round(rng.uniform(0, size), 1), round(rng.uniform(0, size * 0.7), 1))
        for k in range([60, 200, 25][sheet % 3]):
            kind = rng.choice(["text", "mtext", "line", "polyline", "ellipse", "dimension"]) if sheet != 4 else rng.choice(["text", "ellipse"])
            (x, y), (u, v) = spot(), spot()
            path = [(x, y), (u, v)] if kind == "line" else [(x, y), (u, y), (u, v)] if kind == "polyline" else [(x, y)] if kind == "dimension" else None
            parent = rng.choice(["P", "P", "P", "Q", None]) if sheet % 2 else rng.choice(["P", "Q", "R", None])
            rows.append(entity(sheet, k, kind, rng.choice(texts) if kind.endswith("text") else None, None if kind == "line" or rng.random() < 0.02 else x, None if kind == "line" else y, path, parent))
    rows = [r if r[4] is not None else (*r[:5], None, *r[6:]) for r in rows]
    rows.append(entity(50, 1, "text", "nothing at all", 5.0, 5.0))
    rows = [r for r in rows if not (r[2] == "ellipse" and r[4] is None)]
    df = spark.createDataFrame(rows, ENTITY).withColumn("zone", F.lit("clash")).repartition(3)
    got = {}
    for r in zones.detect_zones(df.drop("zone")).collect():
        got.setdefault(r.sheet, {})[r.zone] = ((r.xmin, r.ymin, r.xmax, r.ymax), list(r.anchors))
        assert r.safe == (r.zone in ("tolerance", "shim"))
    names = ["sheet", "ord", "kind", "text", "x", "y", "height", "path", "parent"]
    for sheet in {r[0] for r in rows}:
        want = plain_zones([dict(zip(names, r, strict=True)) for r in sorted(r for r in rows if r[0] == sheet)])
        mine = got.get(sheet, {})
        assert set(mine) == set(want)
        for zone, (box, anchors) in want.items():
            assert mine[zone][0] == pytest.approx(box, abs=1e-6) and mine[zone][1] == anchors, (sheet, zone)
    assert len({z for s in got.values() for z in s}) == 8 and 50 not in got


def test_fold_of_one_large_group_over_many_batches(spark):
    class Sum:
        def __init__(self):
            self.n = 0

        def take(self, rows):
            self.n += len(rows)
            return []

        def end(self):
            return [(self.n,)]

    df = spark.range(50_000).select(F.when(F.col("id") < 45_000, 1).otherwise(F.col("id") % 7 + 2).cast("long").alias("k"), "id").union(spark.sql("select null, 1L"))
    got = {r.k: r.n for r in folds.fold(df, ["k"], ["id"], Sum, "n long").collect()}
    assert got[1] == 45_000 and got[None] == 1 and sum(got.values()) == 50_001


def test_zones_are_ranked_and_peers_tie(spark):
    assert set(zones.OUTSIDE_VIEWS) <= set(zones.ORDER) and zones.PRECEDENCE[-1] == ["views"]
    assert all(zones.RANKS[s] < zones.RANKS[w] for s in ("title", "tolerance", "bom", "shim") for w in ("title_upper_left", "notes", "iso"))
    box = "sheet long, zone string, xmin double, ymin double, xmax double, ymax double"
    z = spark.createDataFrame([(1, n, 0.0, 0.0, 10.0, 10.0) for n in ("views", "notes", "iso", "bom")] + [(1, "title", 8.0, 8.0, 20.0, 20.0), (1, "odd", 0.0, 0.0, 99.0, 99.0), (2, "notes", 0.0, 0.0, 5.0, 5.0)], box)
    p = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 9.0, 9.0), (1, 3, 15.0, 15.0), (1, 4, 50.0, 50.0), (2, 5, 5.0, 5.0), (3, 6, 1.0, 1.0), (1, 7, None, 1.0)], "sheet long, id long, x double, y double").withColumn("zone", F.lit("clash"))
    assert {r.id: r.owner for r in zones.owners(p, z).collect()} == {1: "bom", 2: "title", 3: "title", 4: None, 5: "notes", 6: None, 7: None}
    assert {r.id: r.owner for r in zones.owners(p, z, ["iso", "notes"]).collect()} == {1: "notes", 2: "notes", 3: None, 4: None, 5: "notes", 6: None, 7: None}
    assert {r.id for r in zones.owned_by_other(p, z, "notes").where("vetoed").collect()} == {1, 2, 3}
    assert zones.owned_by_other(p, z, "title").where("vetoed").count() == 0
    assert {r.zone for r in zones.exclusions(z, "notes").collect()} == {"bom", "title"} and zones.exclusions(z, "odd").count() == 0


# -- notes


def test_notes_cohere_with_one_sentence_at_a_time(spark):
    say = "角部は面取りなきこと"
    rows = [
        (1, 1, say, 50.0, 100.0), (1, 2, say, 50.0, 90.0), (1, 3, say, 50.0, 80.0),  # pitch 10
        (1, 4, "1", 38.0, 100.5), (1, 5, "2", 19.9, 90.0), (1, 6, "3", 38.0, 86.0), (1, 7, "10x", 45.0, 80.0), (1, 8, "4", 28.0, 100.0), (1, 9, "5", 20.0, 83.0),
        (1, 10, "x", 8.0, 100.0),  # beside item 8 only: a chain doesn't go on
        (1, 11, say, 300.0, 20.0), (1, 12, "6", 170.0, 20.0), (1, 13, "7", 299.0, 21.0),  # a lone note draws in what is near it, not what is between
        (2, 1, "NOTE: lone", 5.0, 5.0), (2, 2, "1", 4.99, 5.0), (2, 3, "2", 4.9, 5.0), (3, 1, "1", 1.0, 1.0), (4, 1, None, 1.0, 1.0), (4, 2, "注", None, 1.0),
    ]
    df = spark.createDataFrame(rows, "sheet long, ord long, text string, x double, y double").withColumn("pitch", F.lit(1))
    got = {(r.sheet, r.ord): r.seed for r in notes.notes(df, F.col("ord") == 8).collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): True, (1, 11): True, (1, 4): False, (1, 13): False, (1, 9): False, (2, 1): True, (2, 2): False}


def test_note_sentences(spark):
    cases = {
        "注記": True, "注": True, "Note": True, "footnotes": False, "see notes here": True, "面取り": False, "C面取りのこと": True, "〜のこと。": False, "指示なきことxxx": True, "必要な場合は記入のこと": True,
        "施工": False, "表面施工要領": True, "": False, None: False, "  ＮＯＴＥＳ ": True, "ＮＯＴＥＳ１": False, "plain words of length": False, "このことはもう終わり": False,
    }
    df = spark.createDataFrame([(t, w) for t, w in cases.items()], "t string, want boolean")
    bad = [tuple(r) for r in df.withColumn("got", notes.is_note_sentence(F.col("t"))).where("not (got <=> want)").collect()]
    assert bad == []


# -- title blocks


def test_value_below_unless_a_rule_stands_between(spark):
    t = lambda s, o, text, x, y, h=2.5: entity(s, o, "text", text, x, y, height=h)
    rule = lambda s, o, x, lo, hi: entity(s, o, "line", path=[(x, lo), (x, hi)])
    rows = [
        t(1, 1, "Approved", 100.0, 100.0), t(1, 2, "Smith", 94.0, 95.0), t(1, 3, "Jones", 101.0, 80.0), rule(1, 4, 97.0, 90.0, 105.0),  # the nearer one is in the next column
        t(2, 1, "Approved", 100.0, 100.0), t(2, 2, "Smith", 94.0, 95.0), t(2, 3, "Jones", 101.0, 60.0), rule(2, 4, 97.0, 96.0, 105.0),  # a stub is no wall
        t(3, 1, "approved by x", 10.0, 50.0), t(3, 2, "設計", 10.0, 48.0), t(3, 3, "計", 10.0, 47.0), t(3, 4, "Lee", 10.0, 40.0), t(3, 5, "Roe", 14.0, 45.0),  # labels are no values; sideways counts four times
        t(4, 1, "Approved", 0.0, 0.0), t(5, 1, "other", 0.0, 0.0),
        t(6, 1, "Approved", 0.0, 50.0, 5.0), t(6, 2, "XQ", 15.0, 20.0, 5.0),  # twice the letters, twice the reach
        t(7, 1, "Job No", 0.0, 0.0), t(7, 2, "9324", 15.0, 0.1), rule(7, 3, 8.0, -9.0, 9.0),  # rightwards a rule doesn't matter
    ]
    fields = spark.createDataFrame(
        [("approved", ["APPROVED"], [], "first", "below", 8.0, 25.0, 1.0), ("job", ["job no"], ["x"], "low", "right", 20.0, 8.0, 1.0)],
        "field string, patterns array<string>, excluded array<string>, prefer string, direction string, reach_x double, reach_y double, least double",
    )
    got = {(r.sheet, r.field): r.value for r in titles.field_values(spark.createDataFrame(rows, ENTITY), fields).collect()}
    assert got == {(1, "approved"): "Jones", (2, "approved"): "Smith", (3, "approved"): "Lee", (4, "approved"): None, (6, "approved"): "XQ", (7, "job"): "9324"}


def test_value_band(spark):
    table = lambda name, *bands: [(name, k, x, y) for k, (y, xs) in enumerate(bands) for x in xs]
    four = (0.0, 60.0, 120.0, 180.0)
    rows = [
        *table("stray note", (842.0, four), (832.0, four), (822.0, four), (767.5, (58.0,))),
        *table("sparse values", (842.0, four), (832.0, four), (822.0, (1.0,))),
        *table("two strays", (842.0, four), (832.0, four), (767.0, (58.0,)), (743.0, (70.0,))),
        *table("far but full", (842.0, four), (832.0, four), (767.0, (5.0, 66.0))),
        *table("two bands", (842.0, four), (700.0, (58.0,))),
        *table("one column", (30.0, (5.0,)), (20.0, (5.0,)), (-90.0, (500.0,))),
        *table("stacked labels", (842.0, (0.0, 1.0, 20.0, 21.0, 40.0)), (832.0, (0.0,)), (700.0, (0.0,))),
    ]
    got = {r["table"]: r.band for r in titles.value_band(spark.createDataFrame(rows, "table string, band long, x double, y double")).collect()}
    assert got == {"stray note": 2, "sparse values": 2, "two strays": 1, "far but full": 2, "two bands": 1, "one column": 2, "stacked labels": 2}


# -- tables


def plain_table(rows, box, width):
    """[(NO, fields)] of one sheet, row by row."""
    texts = [(r[4] or 0.0, r[5] or 0.0, (r[3] or "").strip()) for r in rows if r[2] == "text" and (r[3] or "").strip()]
    assembly = not any(w in t[2].lower() for t in texts for w in tables.PARTS_WORDS)
    scale = 2.0 if (width > 1200 if width is not None else any(1000 < t[0] < 5000 for t in texts)) else 1.0
    x0, y0, x1, y1 = box or (0.0, 0.0, max(t[0] for t in texts), max(t[1] for t in texts))
    inside = [t for t in texts if x0 <= t[0] <= x1 and y0 <= t[1] <= y1]
    groups = []
    for t in inside:
        for g in groups:
            if abs(t[1] - sum(c[1] for c in g) / len(g)) <= 4.0 * scale:
                g.append(t)
                break
        else:
            groups.append([t])
    full = [g for g in groups if len(g) >= 4]
    start, wide = (box[0], box[2] - box[0] if box[2] > box[0] else 100.0) if box else (0.0, 100.0)
    if (not box or wide > 800) and full:
        xs = [c[0] for g in full for c in g]
        start, wide = min(xs), max(xs) - min(xs) if max(xs) > min(xs) else 100.0
    out = []
    for g in full:
        g = sorted(g, key=lambda c: c[0])
        number = next((c[2] for c in g[:2] if re.fullmatch("[0-9]{1,3}|[a-zA-Z]", c[2])), None)
        labels = [c[2].strip().lower().replace("　", " ").replace("  ", " ") for c in g]
        if number is None or any(v in tables.HEADER_LABELS or any(v.startswith(h) for h in tables.HEADER_LABELS if len(h) > 3) for v in labels):
            continue
        cells = {n: [] for n, _ in (tables.ASSEMBLY_CELLS if assembly else tables.PARTS_CELLS)}
        for x, _, v in g:
            if v != number:
                share = (x - start) / wide if wide > 0 else 0.0
                cells[next(n for n, high in (tables.ASSEMBLY_CELLS if assembly else tables.PARTS_CELLS) if high is None or share < high)].append(v)
        out.append((number, tuple(sorted((n, " ".join(v) or ("1" if n == "QTY" else "NONE")) for n, v in cells.items()))))
    if not out:
        defer = next((t for t in inside if any(m in t[2].replace(" ", "").lower() for m in tables.DEFERRED)), None)
        if defer:
            left = [(x, v) for x, y, v in inside if abs(y - defer[1]) <= 6.0 * scale and x < defer[0] and re.fullmatch("[0-9]{1,3}", v)]
            cells = {n: "NONE" for n, _ in (tables.ASSEMBLY_CELLS if assembly else tables.PARTS_CELLS)} | {"QTY": "1", "TITLE" if assembly else "CODE": defer[2]}
            out.append((max(left, key=lambda p: p[0])[1] if left else "1", tuple(sorted(cells.items()))))
    return sorted(out)


def test_tables_as_row_by_row(spark):
    rng = random.Random(3)
    words = ["SS400", "M10x20", "2", "7", "b", "12.5", "frame", "No.", "Q'ty", "Remark x", "", "  plate ", "表 による"]
    rows, boxes, widths = [], {}, {}
    for sheet in range(14):
        k = 0
        for row in range(rng.randrange(3, 12)):
            y = 100 - row * 7 + 0.0
            for col in range(rng.choice([2, 4, 5, 7])):
                text = str(row) if col == 0 and rng.random() < 0.8 else rng.choice(words[:7] if rng.random() < 0.9 else words)
                rows.append(entity(sheet, k, "text", text, col * 30.0 + rng.choice([0, 0.5, 1, 2]), y + rng.choice([-1.5, 0, 1, 3, 4])))
                k += 1
        if sheet % 2:
            rows.append(entity(sheet, k, "text", "Material Wt (kg)", 500.0, 500.0))
        if sheet % 3 == 0:
            boxes[sheet] = (0.0, 0.0, 200.0, 130.0)
        if sheet % 4 == 1:
            boxes[sheet] = (0.0, 10.0, 950.0, 130.0)
        if sheet % 5 == 2:
            widths[sheet] = 2000.0
    rows += [entity(20, 0, "text", "3", 10.0, 10.0), entity(20, 1, "text", "別表 による", 40.0, 12.0), entity(20, 2, "text", "7", 20.0, 15.0), entity(20, 3, "text", "9", 30.0, 19.0)]
    rows += [entity(21, 0, "text", "別表", 4.0, 4.0), entity(21, 1, "text", "材質", 300.0, 4.0), entity(22, 0, "line", None, 1.0, 1.0), entity(23, 0, "text", "alone", None, None)]
    df = spark.createDataFrame(rows, ENTITY).repartition(3)
    b = spark.createDataFrame([(s, *v) for s, v in boxes.items()], "sheet long, xmin double, ymin double, xmax double, ymax double")
    w = spark.createDataFrame(list(widths.items()), "sheet long, width double")
    got = {}
    for r in tables.table_rows(df, b, w).collect():
        kinds = tables.ASSEMBLY_CELLS if r.assembly else tables.PARTS_CELLS
        got.setdefault(r.sheet, []).append((r.NO, tuple(sorted((n, r[n]) for n, _ in kinds))))
        assert all(r[n] is None for n in tables.FIELDS if n not in dict(kinds))
    for sheet in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == sheet]
        if any(r[2] == "text" for r in own):
            assert sorted(got.get(sheet, [])) == plain_table(own, boxes.get(sheet), widths.get(sheet)), sheet
    assert got[20] == [("7", (("DWG_NO", "NONE"), ("QTY", "1"), ("REMARK", "NONE"), ("TITLE", "別表 による")))] and got[21][0][0] == "1"
    assert sum(map(len, got.values())) > 30


def test_amendment_boxes(spark):
    head = lambda s, o, text, x, y: entity(s, o, "text", text, x, y)
    rows = [
        head(1, 1, "Amd.", 10.0, 10.0), head(1, 2, "Name", 30.0, 10.0), head(1, 3, " Ｙ/Ｍ/Ｄ ", 50.0, 12.0), head(1, 4, "name", 500.0, 400.0), head(1, 5, "names", 51.0, 12.0),
        head(2, 1, "Amd.", 0.0, 0.0), head(2, 2, "Name", 1.0, 0.0), head(3, 1, "担当", 0.0, 0.0), head(3, 2, "符号", 40.0, 40.0), head(4, 1, "amd", None, None), head(4, 2, "amd", 1.0, 1.0),
        head(5, 1, "name", 0.0, 0.0), head(5, 2, "name", 100.0, 0.0), head(5, 3, "name", 55.0, 0.0),  # the third joins the first cluster alone
    ]
    bounds = [(1, 0.0, 0.0, 600.0, 500.0), (2, 0.0, 0.0, 60.0, 60.0), (5, 0.0, 0.0, 800.0, 600.0)]
    b = spark.createDataFrame(bounds, "sheet long, xmin double, ymin double, xmax double, ymax double")
    got = sorted((r.sheet, r.cluster, r.xmin, r.ymin, r.xmax, r.ymax) for r in tables.amendment_boxes(spark.createDataFrame(rows, ENTITY), b).collect())
    assert got == [(1, 0, -10.0, -20.0, 70.0, 42.0), (3, 0, -20.0, -30.0, 60.0, 70.0), (5, 0, -20.0, -30.0, 75.0, 30.0)]


# -- the queries that have no SQL, against the loops above


def sheets_of(spark):
    rows = [r.asDict(recursive=True) for r in sheet_queries.entities(spark, FOLDER).orderBy("sheet", "ord").collect()]
    out = {}
    for r in rows:
        r["path"] = [(p["x"], p["y"]) for p in r["path"]] if r["path"] else None
        out.setdefault(r["sheet"], []).append(r)
    return out


def test_queries_without_sql(spark):
    sheets, queries = sheets_of(spark), catalog.queries()
    got = {(r.sheet, r.zone): ((r.xmin, r.ymin, r.xmax, r.ymax), r.anchors) for r in queries["a23_zone_detection"](spark, FOLDER).collect()}
    want = {(s, z): (tuple(round(v, 6) for v in box), "|".join(a)) for s, rows in sheets.items() for z, (box, a) in plain_zones(rows).items()}
    assert set(got) == set(want)
    assert {k: (got[k], v) for k, v in want.items() if got[k][0] != pytest.approx(v[0], abs=2e-6) or got[k][1] != v[1]} == {}
    boxes = {(r.sheet, r.zone): (r.xmin, r.ymin, r.xmax, r.ymax) for r in queries["a24_grown_boxes"](spark, FOLDER).collect()}
    forms = {"near": (12.0, 6.0, 200.0, 90.0, True), "texts": (30.0, 15.0, 150.0, 60.0, False), "far": (200.0, 200.0, 260.0, 260.0, True)}
    for s, rows in sheets.items():
        first = next((r for r in rows if r["kind"] == "text"), None)
        for zone, (*reach, lines) in forms.items():
            if first:
                points = [p for r in rows for p in ([(r["x"], r["y"])] if r["kind"] == "text" else r["path"][:2] if r["kind"] == "line" and lines else [])]
                assert boxes.pop((s, zone)) == plain_growth(points, (first["x"], first["y"], first["x"], first["y"]), *reach)
    assert not boxes
    parts = {}
    for r in queries["a29_parts_table"](spark, FOLDER).collect():
        parts.setdefault(r.sheet, []).append((r.NO, tuple(sorted((n, r[n]) for n in tables.FIELDS if r[n] is not None))))
    for s, rows in sheets.items():
        own = [(s, r["ord"], r["kind"], r["text"], r["x"], r["y"]) for r in rows]
        assert sorted(parts.get(s, [])) == plain_table(own, (0.0, 0.0, 420.0, 120.0), None)
    assert queries["a27_amendment_boxes"](spark, FOLDER).count() >= 0
