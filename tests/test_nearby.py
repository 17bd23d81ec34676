"""The revision diff where many things of a sheet share key and place."""

import math
import random

from revlens.operators import matching

from .test_flagship import SCHEMA, diff, plain_diff, sheet


def test_ties_and_copies_against_plain_version(spark):
    rng = random.Random(4)
    old, new = [], []
    for pair in range(8):
        spots = [(f"K{rng.randrange(3)}{'AB'[rng.randrange(2)]}", rng.randrange(9) / 8, rng.randrange(9) / 8) for _ in range(40)]
        old += sheet(f"p{pair}", spots + spots[:15])
        new += sheet(f"p{pair}", [(t, x + 0.25, y) for t, x, y in rng.sample(spots * 2, 60)])
    assert diff(spark, old, new) == plain_diff(old, new)


def test_a_sheet_of_one_key_makes_no_pairs_of_all(spark):
    """20,000 things a side: all pairs of them, 400 million, would be neither held nor shuffled."""
    n = 20_000
    rng = random.Random(5)
    rows = [("p", k, "text", "KEY", "KEY", rng.random(), rng.random()) for k in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = matching.spatial_diff(df, df)
    assert found.where("status = 'MATCHED' and old_ord = new_ord").count() == n


def test_nearest_tier_against_all_pairs(spark):
    """Spots at all distances, doubled ones and ties among them."""
    rng = random.Random(9)
    spots = [(k, "ab"[k % 2], rng.choice([rng.random() * 6, rng.randrange(60) / 10]), rng.randrange(60) / 10) for k in range(300)]
    spots += [(1000 + k, *spots[k][1:]) for k in range(40)]
    asked = [(k, "ab"[k % 2], x + rng.choice([0.0, 0.001, 0.03, 0.5]), y) for k, _, x, y in rng.sample(spots, 150)] + [(5000, "a", 50.0, 50.0)]

    def frame(rows, name):
        none = "cast(null as string)"
        return spark.createDataFrame(rows, f"{name} long, type string, x double, y double").selectExpr("*", f"{none} handle", f"{none} parent", f"{none} layer", f"{none} text")

    want = {}
    for k, kind, x, y in asked:
        near = sorted((math.hypot(x - u, y - v), i) for i, other, u, v in spots if other == kind and math.hypot(x - u, y - v) <= 1.0)
        tied = [i for d, i in near if d <= near[0][0] + 1e-9]
        want[k] = (tied[0], "nearest") if len(tied) == 1 else (None, "unresolved")
    got = {r.address_id: (r.entity_id, r.tier) for r in matching.tiered_resolve(frame(asked, "address_id"), frame(spots, "entity_id")).collect()}
    assert got == want and {t for _, t in want.values()} == {"nearest", "unresolved"}


def test_a_crowd_of_one_place_is_one_spot(spark):
    """3,000 entities and addresses at one place: no pairs of all, 9 million."""
    rows = spark.range(3000).selectExpr("id", "cast(null as string) handle", "cast(null as string) parent", "'t' type", "'l' layer", "cast(null as string) text", "1D x", "2D y")
    out = matching.tiered_resolve(rows.withColumnRenamed("id", "address_id"), rows.withColumnRenamed("id", "entity_id"))
    assert out.where("tier = 'unresolved'").count() == 3000
