"""Single linkage over cells against plain loops."""

import math
import random

import pytest

from revlens.operators import rollups


def plain(points, radius):
    root = {p[1]: p[1] for p in points}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (g, i, x, y) in enumerate(points):
        for h, j, u, v in points[:k]:
            if g is not None and g == h and None not in (x, y, u, v) and math.hypot(x - u, y - v) <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in root}


@pytest.mark.parametrize("n,wide", [(150, 90.0), (150, 300.0), (300, 700.0)])
def test_clusters_are_those_of_all_pairs(spark, n, wide):
    rng = random.Random(n + int(wide))
    points = [(rng.choice(["a", "b"]), k % (n - 5), rng.random() * wide, float(rng.randrange(6) * 8 - 20)) for k in range(n)]
    points += [("a", 1000, None, 1.0), (None, 1001, 1.0, 1.0), (None, 1002, 1.0, 1.0), ("c", 1003, 0.0, 0.0), ("c", 1004, 8.0, 0.0), ("c", 1005, 8.0, 8.1)]
    df = spark.createDataFrame(points, "g string, id long, x double, y double")
    got = {r.node: r.cluster for r in rollups.linked_points(df, "g", "id", 8.0).collect()}
    assert got == plain(points, 8.0)


def test_a_dense_place_makes_no_pairs_of_all(spark):
    """60,000 points about one another, 3.6 billion pairs."""
    df = spark.range(60_000).selectExpr("'g' g", "id", "id % 245 / 100 x", "floor(id / 245) / 100 y")
    assert rollups.linked_points(df, "g", "id", 8.0).where("cluster = 0").count() == 60_000
