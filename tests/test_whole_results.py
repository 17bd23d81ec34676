"""Queries that took a part of their rows, against brute force over all of them."""

import difflib
import math
import random
import re
import unicodedata
from collections import Counter

from revlens import catalog
from revlens.functions.text import FOLDS
from revlens.operators import ordered


def grams(text):
    out = Counter()
    for word in text.lower().split():
        word = f" {word} "
        for n in (2, 3, 4):
            out.update(word[i : i + n] for i in range(len(word) - n + 1))
    return out


def test_tfidf_search_finds_all_turns(spark, tmp_path):
    turns = [(c, k, f"{w} talk number {c} of turn {k} {w * 2}") for c in range(6) for k, w in enumerate(["opening", "answering", "closing"])]
    asked = [(0, "answering talk number 4"), (1, "closing closing 2"), (30, "opening talk of turn")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {(c, k): grams(t) for c, k, t in turns}
    df = Counter(g for d in docs.values() for g in d)

    def vector(counts):
        v = {g: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in counts.items() if g in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    want = set()
    for item, text in asked:
        q = vector(grams(text))
        scores = [(-round(sum(x * vector(d).get(g, 0) for g, x in q.items()), 6), key) for key, d in docs.items()]
        want |= {(item, *key, rank) for rank, (_, key) in enumerate(sorted(scores)[:3], 1)}
    got = {(r.item_id, r.conv_id, r.turn, r["rank"]) for r in catalog.queries()["l01_tfidf_search"](spark, str(tmp_path)).collect()}
    assert got == want and {k for _, _, k, _ in got} == {0, 1, 2}


def test_mutual_best_of_whole_texts_and_all_turns(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["plan", "wall", "door", "beam", "of", "note", "axis", "level", "duct", "x1"]) for _ in range(n))
    items = [(k, "same opening words for every one of these items, all of sixty characters " + say(20)) for k in range(8)]
    turns = [(c, k, say(rng.randint(1, 25))) for c in range(30) for k in range(4)]
    turns += [(50 + k, 3, text[:-6] + "end") for k, text in items] + [(70, 0, ""), (71, 5, items[0][1])]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    score = {(i, c * 1000 + k): round(difflib.SequenceMatcher(None, a, b).ratio(), 6) if b else 0.0 for i, a in items for c, k, b in turns}
    want = {}
    for (i, n), s in score.items():
        others = [t for (j, m), t in score.items() if (j == i) != (m == n)]
        if s >= 0.3 and all(s - t >= 0.01 for t in others):
            want[i, n] = s
    got = {(r.old_id, r.new_id): r.score for r in catalog.queries()["j06_mutual_best"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) >= 4


def test_natural_sort_places_all_rows(spark, tmp_path):
    rng = random.Random(7)
    parts = [(k, rng.choice(["M", "", "bolt ", "A-"]) + rng.choice(["", str(rng.randrange(30)), f"{rng.randrange(9)}x2"])) for k in range(700)]
    spark.createDataFrame(parts, "p_partkey long, p_type string").repartition(5).write.parquet(f"{tmp_path}/part.parquet")

    def key(part):
        digits = re.search("[0-9]+", part[1])
        return (0, int(digits[0]), part[1], part[0]) if digits else (1, 0, part[1], part[0])

    want = {p[0]: place for place, p in enumerate(sorted(parts, key=key), 1)}
    got = catalog.queries()["w13_natural_sort_all"](spark, str(tmp_path)).collect()
    assert {r.p_partkey: r.place for r in got} == want and len(got) == 700
    empty = spark.createDataFrame([], "p_partkey long, p_type string")
    assert ordered.placed(empty, list(ordered.natural_key(empty.p_type)), "p_partkey").count() == 0


def test_bm25_answers_all_items(spark):
    folder = "/root/testdata/sf0.001"
    asked = {r.item_id for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {r.item_id for r in catalog.queries()["l02_bm25_all"](spark, folder).collect()}
    assert got == asked and len(got) == 40


def test_keys_of_all_texts_with_signs_to_fold(spark, tmp_path):
    signs = "".join(old for old, _ in FOLDS) + "ＡＢＣ①ﾊﾟ㎜ﬁ Ａ　Ｂ\t\n"
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice(signs + "xyz DIA deg") for _ in range(rng.randrange(40)))) for k in range(300)] + [(900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def key(t):
        t = re.sub("[ \\n\\t\\r\u3000]+", "", unicodedata.normalize("NFKC", t).lower())
        for old, new in FOLDS:
            t = t.replace(old, new)
        return t

    got = {r.doc_id: r.key for r in catalog.queries()["x01_normal_key"](spark, str(tmp_path)).collect()}
    assert got == {k: key(t) if t is not None else None for k, t in rows}


def test_ratio_of_neighbouring_turns(spark, tmp_path):
    rng = random.Random(9)
    turns = [(c, k, " ".join(rng.choice(["plan", "wall", "door"]) for _ in range(rng.randrange(4))) or None) for c in range(20) for k in range(rng.randrange(1, 5))]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = {(c, k): t for c, k, t in turns}
    got = {(r.conv_id, r.turn): r.ratio for r in catalog.queries()["x10_ratio"](spark, str(tmp_path)).collect()}
    for (c, k), a in text.items():
        b = text.get((c, k + 1))
        assert got.pop((c, k)) == (round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 6) if a and b else 0.0)
    assert not got
