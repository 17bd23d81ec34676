"""Projection against a plain walk, mutations on any partitioning, and sweeps against one run a setting."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import evaluation, projection
from revlens.plans import measure_queries

FOLDER = "/root/testdata/sf0.001"
P = "struct<x:double,y:double>"
VIEWS = "sheet long, index int, paper_x double, paper_y double, paper_w double, paper_h double, anchor_x double, anchor_y double, view_h double, scale double"


def plain_project(geometry, views):
    """(geometry, index, scale, outside) by walking a dict; points are (x, y[, z]) tuples."""
    if not views or geometry is None:
        return geometry, -1, 1.0, False
    points = [geometry[k] for k in ("start", "end") if geometry[k]] + [p for p in geometry["points"] or [] if p] + [p for g in geometry["groups"] or [] if g for p in g if p]
    points = [p for p in points if p[0] is not None and p[1] is not None]
    if not points:
        return geometry, -1, 1.0, False
    x, y = points[0][:2]

    def shows(v):
        _, px, py, pw, ph, ax, ay, vh, s = v
        half = pw / s * 0.5 if s else 0.0
        return ax - half <= x <= ax + half and ay - vh / 2 <= y <= ay + vh / 2

    views = sorted(views)
    shown = next((v for v in views if shows(v)), None)
    index, px, py, _, _, ax, ay, _, s = shown or views[0]
    move = lambda p: p if p is None or p[0] is None or p[1] is None else (px + (p[0] - ax) * s, py + (p[1] - ay) * s, *p[2:])
    out = dict(geometry)
    for k in ("start", "end"):
        out[k] = move(geometry[k])
    out["points"] = [move(p) for p in geometry["points"]] if geometry["points"] is not None else None
    out["groups"] = [[move(p) for p in g] if g is not None else None for g in geometry["groups"]] if geometry["groups"] is not None else None
    out["axis"] = tuple(v * s for v in geometry["axis"]) if geometry["axis"] else None
    out["radius"] = geometry["radius"] * s if geometry["radius"] is not None else None
    return out, index, s, shown is None


def test_records_are_projected_leaf_by_leaf(spark):
    rng = random.Random(1)
    at = lambda: (rng.uniform(0, 100), rng.uniform(0, 100))
    some = lambda v: v if rng.random() < 0.8 else None
    schema = f"sheet long, id long, geometry struct<note:string, radius:double, start:struct<x:double,y:double,z:double>, groups:array<array<{P}>>, end:{P}, axis:{P}, points:array<{P}>, angle:double, size:struct<w:double,h:double>>, view_scale string"
    rows = []
    for k in range(300):
        g = (some("n"), some(2.0), some((*at(), 7.0)), some([some([some(at()) for _ in range(2)]) for _ in range(2)]), some(at()), some((1.0, 2.0)), some([some(at()), (None, 1.0), at()]), 30.0, (1.0, 2.0))
        rows.append((k % 4, k, some(g), "clash"))
    views = [(0, 0, 10.0, 10.0, 40.0, 40.0, 50.0, 50.0, 60.0, 0.5), (0, 1, 5.0, 5.0, 60.0, 10.0, 10.0, 10.0, 40.0, 2.0), (1, 3, 0.0, 0.0, 500.0, 500.0, 50.0, 50.0, 500.0, 1.5), (2, 0, 1.0, 1.0, 9.0, 9.0, 0.0, 0.0, 9.0, 0.0)]
    out = projection.project_records(spark.createDataFrame(rows, schema), spark.createDataFrame(views, VIEWS), "sheet", lengths=["radius", "angle_of_none"], vectors=["axis"])
    assert set(out.columns) == {"sheet", "id", "geometry", "view_scale", "view_index", "outside"} and out.schema["geometry"].dataType == spark.createDataFrame(rows, schema).schema["geometry"].dataType
    names = ["note", "radius", "start", "groups", "end", "axis", "points", "angle", "size"]

    def bare(v):
        return tuple(bare(x) for x in v) if isinstance(v, list | tuple) else round(v, 9) if isinstance(v, float) else v

    got = {r.id: (bare(tuple(r.geometry)) if r.geometry else None, r.view_index, r.view_scale, r.outside) for r in out.collect()}
    for sheet, id_, g, _ in rows:
        want, index, scale, outside = plain_project(dict(zip(names, g, strict=True)) if g else None, [v[1:] for v in views if v[0] == sheet])
        if g is None:
            assert got[id_][0] is None and got[id_][1] == -1
        else:
            assert got[id_] == (bare(tuple(want.values())), index, scale, outside), id_
    assert {v[1] for v in got.values()} == {-1, 0, 1, 3} and any(v[3] for v in got.values())


def test_paper_points_go_back_and_stay_on_the_sheet_outside(spark):
    views = spark.createDataFrame([(1, 0, 10.0, 10.0, 4.0, 4.0, 100.0, 50.0, 8.0, 0.5), (1, 1, 11.0, 10.0, 4.0, 4.0, 0.0, 0.0, 4.0, 0.0)], VIEWS)
    points = spark.createDataFrame([(1, 11.0, 11.0, None), (1, 30.0, 1.0, None), (1, 12.5, 10.0, None), (1, 11.0, 11.0, 1), (2, 5.0, 5.0, None), (1, None, 5.0, None)], "sheet long, x double, y double, own int")
    got = [(r.model_x, r.model_y, r.view_index) for r in projection.unproject_points(points, views, "sheet", index="own").collect()]
    assert sorted(got, key=str) == sorted([(102.0, 52.0, 0), (30.0, 1.0, -1), (12.5, 10.0, 1), (11.0, 11.0, 1), (5.0, 5.0, -1), (None, 5.0, -1)], key=str)


def test_mutations_are_the_same_on_any_partitions_and_true(spark):
    base = measure_queries.sheets_to_change(spark, FOLDER)
    base = spark.createDataFrame(base.collect(), base.schema)
    key = lambda df: sorted(map(str, df.collect()))
    a, b = evaluation.mutate(base.repartition(1), 42), evaluation.mutate(base.repartition(7), 42)
    assert key(a.entities) == key(b.entities) and key(a.truth) == key(b.truth) and key(a.truth) != key(evaluation.mutate(base, 43).truth)
    old = {(r.sheet, r.ord): r for r in base.collect()}
    new = {(r.sheet, r.ord): r for r in a.entities.collect()}
    truth = a.truth.collect()
    plan = a.plan.collect()
    sheets = {s for s, _ in old}
    assert len(new) == a.entities.count() and 0 < len(sheets - {r.sheet for r in plan}) < len(sheets)
    for r in truth:
        if r.status == "REMOVED":
            assert (r.sheet, r.old_ord) not in new and old[r.sheet, r.old_ord].text == r.old_text and r.new_ord is None
        elif r.status == "ADDED":
            assert (r.sheet, r.new_ord) not in old and new[r.sheet, r.new_ord].text == r.new_text
        else:
            o, n = old[r.sheet, r.old_ord], new[r.sheet, r.new_ord]
            assert (o.text, n.text) == (r.old_text, r.new_text) and o.text != n.text and (o.x, o.y) == (n.x, n.y)
    told = {(r.sheet, o) for r in truth for o in (r.old_ord, r.new_ord) if o is not None}
    silent = {(r.sheet, r.ord) for r in plan if r.operator in ("restyle_dimension_text", "translate_entities") and r.ord is not None}
    for k in old:
        if k not in told:
            same = new[k] == old[k]
            assert same == (k not in silent), k
            if k in silent:
                assert new[k].measurement == old[k].measurement and abs(new[k].x - old[k].x) <= 3 and abs(new[k].y - old[k].y) <= 3
    assert {r.status for r in truth} == {"CHANGED", "REMOVED", "ADDED"} and len({(r.sheet, r.ord) for r in plan if r.ord}) == sum(r.ord is not None for r in plan)


def test_chosen_operators_and_odd_sheets(spark):
    cols = "sheet long, ord long, kind string, text string, x double, y double, zone string, measurement double"
    rows = [(1, 1, "text", "007 bolts", 1.0, 1.0, "notes", None), (1, 2, "dimension", "%%c9.5 H7", 0.0, 0.0, "views", 9.5), (2, 1, "text", " ", 0.0, 0.0, "notes", None), (3, 5, "text", "no digits", 0.0, 0.0, "title", None), (4, 1, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, cols)
    made = evaluation.mutate(df, 1, operators=["edit_text", "edit_dimension_measurement", "edit_title_field", "edit_text"])
    truth = {(r.sheet, r.operator): r for r in made.truth.collect()}
    assert set(truth) == {(1, "edit_text"), (1, "edit_dimension_measurement"), (3, "edit_title_field")}
    assert truth[1, "edit_text"].new_text in {f"{max(0, 7 + d):03d} bolts" for d in evaluation.STEPS}
    assert truth[1, "edit_dimension_measurement"].new_text in {f"%%c{9.5 + d:g} H7" for d in evaluation.MEASURES}
    assert truth[3, "edit_title_field"].new_text in {"no digits" + c for c in evaluation.LETTERS}
    assert made.entities.count() == 5 and sum(r.ord is None for r in made.plan.collect()) == 4 * 4 - 3
    nothing = evaluation.mutate(df.where("false"), 1)
    assert nothing.entities.count() == 0 and nothing.truth.count() == 0


def test_flagship_finds_planted_changes(spark):
    """Recall and precision of the comparison on sheets with three planted changes each; the figures stand in README."""
    got = {r.status: r for r in measure_queries.book.queries["g11_planted_recall"](spark, FOLDER).collect()}
    n_truth, n_right, n_found = (sum(getattr(r, c) for r in got.values()) for c in ("n_truth", "n_right", "n_found"))
    assert n_truth >= 10 and n_right / n_truth >= 0.8 and n_right / n_found >= 0.7, (n_truth, n_right, n_found)


def test_sweep_equals_one_run_for_each_setting(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.randrange(60), round(rng.uniform(0, 20), 2), round(rng.random(), 2)) for _ in range(900)]
    df = spark.createDataFrame([(o, n, d, a, o == n) for o, n, d, a in rows], "o long, n long, d double, a double, same boolean").repartition(3)
    settings = evaluation.one_at_a_time({"radius": 9.0, "floor": 0.4}, {"radius": [0.0, 3.0, 15.0], "floor": [0.9, 0.0]})
    swept = evaluation.sweep(df, ["o"], settings, lambda s: (F.col("d") <= s["radius"]) & (F.col("a") >= s["floor"]), lambda s: [F.col("a") - F.col("d") * s["floor"], -F.col("n")], F.col("same"), 60)
    got = {(r.name, r.value): (r.n_found, r.n_right, r.precision, r.f1) for r in swept.collect()}
    assert len(got) == 6
    for name, value, s in settings:
        best = {}
        for o, n, d, a in rows:
            if d <= s["radius"] and a >= s["floor"]:
                best[o] = max(best.get(o, (-1e9, 0)), (a - d * s["floor"], -n))
        right = sum(-n == o for o, (_, n) in best.items())
        assert got[name, value] == (len(best), right, right / len(best) if best else None, pytest.approx(2 * right / (len(best) + 60)))
    spread = {r.name: r.spread for r in evaluation.sensitivity(swept).collect()}
    assert set(spread) == {"radius", "floor"} and spread["radius"] > 0
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1
    with pytest.raises(KeyError):
        evaluation.one_at_a_time({"a": 1.0}, {"b": [1.0]})
