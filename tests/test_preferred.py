"""Tiered scoring with preferences against a plain loop."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from revlens import catalog
from revlens.operators import scoring
from revlens.plans import measure_queries

FOLDER = "/root/testdata/sf0.001"
COLS = "pair_id long, {} long, handle string, texts array<string>, x double, y double, category string, status string"


def plain_scores(labels, found):
    """[(label, found, tier)] and [(kind, id)] of one pair."""
    left, open_, matches = list(found), list(labels), []
    for tier in ("handle", "text", "spatial"):
        rest = []
        for m in open_:
            options = []
            for k, p in enumerate(left):
                far = 0.0
                if tier == "handle":
                    ok = bool(m["handle"]) and m["handle"] == p["handle"]
                elif tier == "text":
                    ok = bool({t for t in m["texts"] or [] if t} & {t for t in p["texts"] or [] if t})
                else:
                    ok = None not in (m["x"], m["y"], p["x"], p["y"])
                    far = math.hypot(m["x"] - p["x"], m["y"] - p["y"]) if ok else 0.0
                    ok = ok and far <= scoring.NEAR
                if ok:
                    options.append((p["category"] != m["category"], p["status"] != m["status"], far, k))
            if options:
                matches.append((m["label_id"], left.pop(min(options)[-1])["found_id"], tier))
            else:
                rest.append(m)
        open_ = rest
    hit = {a for a, _, _ in matches}
    told = [m for m in labels if m["label_id"] in hit]
    kinds = [("matched", a) for a in hit] + [("missed" if m["resolved"] else "unresolvable", m["label_id"]) for m in open_]
    for p in left:
        again = any(p["category"] == m["category"] and ((p["handle"] and p["handle"] == m["handle"]) or {t for t in p["texts"] or [] if t} & {t for t in m["texts"] or [] if t}) for m in told)
        kinds.append(("duplicate" if again else "spurious", p["found_id"]))
    return matches, kinds


def test_query_scores_as_a_loop(spark):
    labels, found = (df.collect() for df in measure_queries._labels_and_findings(spark, FOLDER))
    sides = defaultdict(lambda: ([], []))
    for r in sorted(labels, key=lambda r: r.label_id):
        sides[r.pair_id][0].append(r.asDict())
    for r in sorted(found, key=lambda r: r.found_id):
        sides[r.pair_id][1].append(r.asDict())
    want, kinds = set(), Counter()
    for pair, (a, b) in sides.items():
        m, k = plain_scores(a, b)
        want |= {(pair, *x) for x in m}
        kinds.update((pair, *x) for x in k)
    got = {(r.pair_id, r.label_id, r.found_id, r.tier) for r in catalog.queries()["j23_preferred_matches"](spark, FOLDER).collect()}
    assert got == want and {t for *_, t in got} == {"handle", "text", "spatial"}
    assert Counter((r.pair_id, r.kind, r.id) for r in catalog.queries()["u06_preferred_outcomes"](spark, FOLDER).collect()) == kinds
    assert {k for _, k, _ in kinds} == {"matched", "missed", "unresolvable", "duplicate", "spurious"}


def test_category_is_preferred_and_no_filter(spark):
    labels = [(1, 1, "", ["a"], None, None, "bom", "CHANGED"), (1, 2, "h9", None, 0.0, 0.0, "views", "ADDED"), (2, 1, "", [""], 0.0, 0.0, "views", "ADDED"), (2, 2, "", [], 1.0, 0.0, "views", "ADDED")]
    found = [(1, 10, "", ["a"], None, None, "views", "CHANGED"), (1, 11, "", ["a"], None, None, "bom", "ADDED"), (1, 12, "", ["a"], None, None, "bom", "CHANGED"), (2, 10, "", [""], 36.0, 0.0, "views", "ADDED"), (2, 11, None, None, 35.0, 0.0, "bom", "ADDED")]
    a, b = spark.createDataFrame(labels, COLS.format("label_id")).withColumns({"resolved": F.lit(True), "old": F.lit(1)}), spark.createDataFrame(found, COLS.format("found_id"))
    m = scoring.preferred_matches(a, b)
    assert {(r.pair_id, r.label_id, r.found_id, r.tier) for r in m.collect()} == {(1, 1, 12, "text"), (2, 1, 11, "spatial"), (2, 2, 10, "spatial")}
    kinds = {(r.pair_id, r.kind, r.id) for r in scoring.preferred_outcomes(a, b, m).collect()}
    assert {(1, "duplicate", 11), (1, "spurious", 10), (1, "missed", 2)} <= kinds
    assert scoring.preferred_matches(a.where("false"), b).count() == 0
