"""Pairs of lines that the word join leaves to be verified."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.llm import linededup
from revlens.llm.common import Scratch


def near_misses(rng, n):
    """Lines of one long base, of which each has lost so many words to rarer ones that no two of them match."""
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(n):
        lost = set(rng.sample(range(100), 14))
        rows.append((i, " ".join(f"r{rng.randrange(1200)}" if k in lost else w for k, w in enumerate(base))))
    return rows


def similar(rows, share=0.8):
    sets = [(i, set(t.split())) for i, t in rows]
    return {(a, b) for a, s in sets for b, t in sets if b < a and len(s & t) >= share * len(s | t) - 1e-9}


def classes_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark)
    classes = linededup.line_classes(df, scratch, 0.8, "doc_id", "text")
    ids = {r.id: r.doc for r in classes.select("id", "doc").collect()}
    return classes, scratch, ids, spark.createDataFrame([], "late long")


class Counted(Scratch):
    """Adds up the rows that the join made."""

    rows = 0

    def save(self, df):
        back = super().save(df)
        if "met" in back.columns:
            self.rows += back.agg(F.sum("met")).first()[0] or 0
        return back


def test_near_misses_make_few_rows(spark):
    """A pair of near misses shares many words of its fronts, but rarely those that a match would have to share."""
    rows = near_misses(random.Random(5), 300)
    classes, _, ids, none = classes_of(spark, rows)
    counted = Counted(spark)
    pairs = {(ids[r.late], ids[r.early]) for r in linededup.candidates(classes, none, 0.8, counted).collect()}
    assert similar(rows) <= pairs
    word = classes.select("id", F.explode("front").alias("word"))
    common = word.alias("a").join(word.alias("b"), F.expr("a.word = b.word and a.id < b.id")).count()
    assert 5 * counted.rows < common


@pytest.mark.parametrize("slices", [1, 4])
def test_no_match_is_lost(spark, slices):
    """Sizes of 1 to 60, matches from equal to just at the threshold, in any number of slices."""
    rng = random.Random(slices)
    rows = []
    for i in range(360):
        words = rng.sample([f"w{k}" for k in range(90)], rng.randrange(1, 60)) if i < 40 else rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.randrange(0, 1 + max(1, len(words) // 8)) if i >= 40 else 0):
            k = rng.random()
            if k < 0.4 and len(words) > 1:
                words.pop(rng.randrange(len(words)))
            elif k < 0.7:
                words.append(f"w{rng.randrange(90)}")
            else:
                words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(dict.fromkeys(words))))
    classes, scratch, ids, none = classes_of(spark, rows)
    pairs = {(ids[r.late], ids[r.early]) for r in linededup.candidates(classes, none, 0.8, scratch, slices).collect()}
    firsts = set(ids.values())
    want = {(a, b) for a, b in similar(rows) if a in firsts and b in firsts}
    assert len(want) > 100 and want <= pairs
    settled = classes.where("id % 2 = 1").select(F.col("id").alias("late"))
    odd = {(ids[r.late], ids[r.early]) for r in linededup.candidates(classes, settled, 0.8, scratch, slices).collect()}
    even = {d for i, d in ids.items() if i % 2 == 0}
    assert odd == {(a, b) for a, b in pairs if a in even}


def test_hot_steps_are_compiled(spark):
    """Classes are dealt to their groups, and sets compared, by generated code; the sets hold hashes, not words."""
    saved = []

    class Seen(Scratch):
        def save(self, df):
            saved.append(df)
            return super().save(df)

    rows = near_misses(random.Random(6), 40) + [(50, " x\ty  z x "), (51, "z x y"), (52, "y z  x\x0c")]
    classes, scratch, ids, _ = classes_of(spark, rows)
    assert {ids[r.id]: r.n for r in classes.collect() if ids[r.id] >= 50} == {50: 3}
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = linededup.likely_matches(classes, 0.8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    steps = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert steps and all("*(" in line for line in steps)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(linededup, "Scratch", Seen)
        linededup.staying_lines(spark.createDataFrame(rows + [(60, rows[0][1] + " more")], "doc_id long, text string"))
    kinds = [dict(df.dtypes)["set"] for df in saved if "set" in df.columns]
    assert kinds == ["array<bigint>"] * 2
