"""Extents of what many placements of a few blocks draw."""

from pyspark.sql import functions as F

from revlens.operators import blocks

from .test_sheets import DEF

NAMES = [f.split()[0] for f in DEF.split(", ")]
TREE = 10


def tree(spark):
    """A block that places two blocks, which place two each, ten levels down; each draws a line and a text."""
    rows = []
    for b in range(2 ** (TREE + 1)):
        rows += [(f"B{b}", k, "insert", f"B{2 * b + k}", None, None, None, None, None, None, 2.0 * k, 1.0, 37.0 * k, 1.0 + k / 8, None) for k in (0, 1)] if 0 < b < 2**TREE else []
        rows += [(f"B{b}", 2, "line", None, b % 9 * 1.0, 1.0, 3.0, b % 5 * 1.0, None, None, None, None, None, None, None), (f"B{b}", 3, "text", None, 7.0, 8.0, None, None, None, "t", None, None, None, None, None)]
    return spark.createDataFrame(rows, DEF)


def placed(spark, n, deep):
    at = [(F.col("id") % k * 1.0).alias(c) for c, k in (("at_x", 11), ("at_y", 7))]
    turn = F.when(F.col("id") % 3 > 0, F.col("id") % 3 * 45.0).alias("turn")
    return spark.range(n).select(F.floor(F.col("id") / 2).alias("id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("B"), F.col("id") % 2 + deep)).alias("block"), *at, turn, (F.col("id") % 2 + 1.0).alias("scale_x"), F.lit(None).cast("double").alias("scale_y"))


def same_as_exploded(spark, nested):
    defs, places = tree(spark), placed(spark, 60, 64)
    got = blocks.extents(places, defs, "id", nested=nested).collect()
    want = blocks.exploded(places, defs, "id", nested=nested).groupBy("id", "kind").agg(
        F.count(F.lit(1)), F.max(F.size("path") - 1), F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1"), F.max("x2"), F.max("r")
    ).collect()
    plain = lambda rows: sorted([tuple(round(v, 6) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in rows])
    assert plain(got) == plain(want) and len(got) > 40


def many(spark, nested):
    """200,000 placements of a tree of 2,047 blocks: 400 million things of a kind, were each drawn on its own."""
    out = blocks.extents(placed(spark, 200_000, 1), tree(spark), "id", nested=nested)
    n = out.where("kind = 'text'").agg(F.sum("n").alias("n"), F.max("deepest").alias("deepest")).first()
    size = {0: 2 ** (TREE + 1) - 1, 1: 2**TREE - 1}  # of the trees under B1 and B2
    assert n.n == sum(size[k % 2] for k in range(200_000) if k % 5)
    assert n.deepest == TREE


def test_extents_are_those_of_the_things(spark):
    same_as_exploded(spark, True)


def test_many_placements_of_a_tree(spark):
    many(spark, True)


def test_innermost_extents_are_those_of_the_things(spark):
    same_as_exploded(spark, False)


def test_many_placements_of_a_tree_by_innermost_transform(spark):
    many(spark, False)
