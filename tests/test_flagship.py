"""The revision diff on hand-checked sheets and against a plain version; clusters of chains; file readers."""

import difflib
import math
import random

import pytest

from revlens.operators import matching, rollups
from revlens.sources import files

SCHEMA = "pair_id string, ord long, kind string, key string, text string, x double, y double"


def sheet(pair, entries):
    return [(pair, k, "text", t, t, float(x), float(y)) for k, (t, x, y) in enumerate(entries)]


def plain_diff(old, new, strict=0.005, twin=0.010, fuzzy=0.150, floor=0.40):
    """The same rules, one sheet pair at a time, in loops."""
    found = []
    for pair in {r[0] for r in old} & {r[0] for r in new}:
        a, b = ([r for r in side if r[0] == pair] for side in (old, new))
        dist = lambda p, q: math.hypot(q[5] - p[5], q[6] - p[6])
        offsets = []
        for q in b:
            near = sorted((dist(p, q), p[1], p) for p in a if p[2:4] == q[2:4] and len(q[3]) > 2)
            if near:
                p = near[0][2]
                offsets.append((round(q[5] - p[5], 6), round(q[6] - p[6], 6)))
        dx, dy = (sorted(o[i] for o in offsets)[len(offsets) // 2] if offsets else 0.0 for i in (0, 1))
        moved = [(*q[:5], q[5] - dx, q[6] - dy) for q in b]
        hit = sum(any(p[2:4] == q[2:4] and dist(p, q) <= strict for p in a) for q in moved)
        radius = twin if hit / len(moved) >= 0.8 else fuzzy
        free_a, free_b = {p[1]: p for p in a}, {q[1]: q for q in moved}

        def run(edges, status):
            for _, n, o in sorted(edges):
                if n in free_b and o in free_a:
                    del free_b[n], free_a[o]
                    found.append((pair, o, n, status))

        for limit in (radius, max(fuzzy, 5 * radius)):
            run([(dist(p, q), q[1], p[1]) for p in free_a.values() for q in free_b.values() if p[2:4] == q[2:4] and dist(p, q) <= limit], "MATCHED")
        edges = []
        for p in free_a.values():
            for q in free_b.values():
                s = difflib.SequenceMatcher(None, p[3], q[3]).ratio()
                if p[2] == q[2] and p[3] != q[3] and dist(p, q) <= radius and s >= floor:
                    edges.append((dist(p, q) + 1000 - 100 * s, q[1], p[1]))
        run(edges, "CHANGED")
        found += [(pair, o, None, "REMOVED") for o in free_a] + [(pair, None, n, "ADDED") for n in free_b]
    return set(found)


def diff(spark, old, new):
    rows = matching.spatial_diff(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)).collect()
    return {(r.pair_id, r.old_ord, r.new_ord, r.status) for r in rows}


def test_widened_pass_keeps_texts_apart(spark):
    same = [(f"OK{i}", i / 100, i / 100) for i in range(1, 5)]
    old, new = sheet("p", [*same, ("R2", 0.52, 0.51)]), sheet("p", [*same, ("C5", 0.50, 0.50)])
    want = {("p", k, k, "MATCHED") for k in range(4)} | {("p", 4, None, "REMOVED"), ("p", None, 4, "ADDED")}
    assert diff(spark, old, new) == want


def test_offset_of_nearest_candidate(spark):
    old, new = sheet("p", [("PART5", 1.0, 1.0), ("PART5", 0.0, 0.0)]), sheet("p", [("PART5", 0.005, 0.005)])
    assert diff(spark, old, new) == {("p", 1, 0, "MATCHED"), ("p", 0, None, "REMOVED")}


def test_diff_against_plain_version(spark):
    rng = random.Random(6)
    old, new = [], []
    for pair in range(6):
        base = [(f"{rng.choice(['ALPHA', 'BETA', 'GAMMA'])}{rng.randrange(6)}", rng.random(), rng.random()) for _ in range(25)]
        edited = [
            (t if rng.random() < 0.8 else t[:-1] + "X", x + 0.3 + rng.gauss(0, 0.002), y - 0.2 + rng.gauss(0, 0.002))
            for t, x, y in base
            if rng.random() < 0.9
        ]
        old += sheet(f"p{pair}", base)
        new += sheet(f"p{pair}", edited)
    assert diff(spark, old, new) == plain_diff(old, new)


def test_clusters_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1002), (1003, 1003)]
    random.Random(2).shuffle(chain)
    got = {r.node: r.cluster for r in rollups.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(401)} | {i: 1000 for i in (1000, 1001, 1002)} | {1003: 1003}
    assert rollups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_markdown_headings(spark):
    text = "before the first heading it is long\n# One\nbody of one with enough\n```\n# not a heading\n```\n## Two\nshort\n# One\nanother body with enough"
    rows = files.heading_chunks(spark.createDataFrame([(1, text), (2, None)], "doc long, text string"), "doc", "text").collect()
    assert [(r.doc, r.heading, r.body) for r in sorted(rows, key=lambda r: r.no)] == [
        (1, "", "before the first heading it is long"), (1, "One", "body of one with enough"), (1, "One#2", "another body with enough")
    ]


def test_sections_are_cut_by_size(spark):
    text = "intro\n" + "\n".join("x" * 99 for _ in range(12)) + "\n1.2 Title\nrest"
    rows = files.section_chunks(spark.createDataFrame([(1, text)], "doc long, text string"), "doc", "text").orderBy("first_line").collect()
    assert [(r.section, r.chunk, r.first_line, r.last_line) for r in rows] == [("General", 0, 0, 10), ("General", 1, 11, 12), ("1.2 Title", 0, 13, 14)]


def test_sheet_rows(spark):
    cells = [("s", k, c, f"{k}{c}", c == 0 and k == 0, "red" if k == 1 else None) for k in range(12) for c in range(2)] + [("t", 0, 0, "", False, None), ("t", 1, 0, "z", False, "green")]
    df = spark.createDataFrame(cells, "sheet string, row int, col int, text string, bold boolean, mark string")
    rows = {(r.sheet, r.chunk): r.body.split("\n") for r in files.sheet_rows(df, ["sheet"], "row", "col", "text", "bold", "mark").collect()}
    assert rows[("s", 0)][:2] == ["**00** | 01", "[red] 10 | 11"] and len(rows[("s", 0)]) == 10 and len(rows[("s", 1)]) == 2
    assert rows[("t", 0)] == ["[green] z"]


def test_json_lines_and_slices(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "k long, t string, v double")
    files.write_json_lines(df, f"{tmp_path}/lines")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == ['{"k":1,"t":"a","v":null}', '{"k":2,"t":null,"v":0.5}']
    back = files.read_json_lines(spark, f"{tmp_path}/lines", "k long, t string, v double")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    files.write_slices(df, f"{tmp_path}/slices", "k")
    files.write_slices(spark.createDataFrame([(2, "new", 1.0)], df.schema), f"{tmp_path}/slices", "k")
    assert {r.t for r in spark.read.parquet(f"{tmp_path}/slices").collect()} == {"a", "new"}
    assert [r.t for r in files.entities(spark, f"{tmp_path}/slices", "k", 2).collect()] == ["new"]
    assert {tuple(r) for r in files.replace_slices(df, spark.createDataFrame([(2, "x", 3.0)], df.schema), "k").collect()} == {(1, "a", None), (2, "x", 3.0)}


@pytest.mark.parametrize("reason,want", [("", {1}), ("audit", {1, 2})])
def test_held_out_needs_a_reason(spark, reason, want):
    manifest = spark.createDataFrame([(1, False), (2, True)], "k long, held boolean")
    payload = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert {r.k for r in files.corpus(manifest, payload, "k", "held", reason).collect()} == want
