"""The pipeline's near-copy stage against brute-force Jaccard of five-word shingles."""

import random

import pytest

import corpus_pipeline
from revlens.llm import shingles

from .test_operators import roots, sentence


def shingles_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def kept_by_brute_force(rows):
    rows = sorted(rows)
    sets = [shingles_of(t) for _, t in rows]
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if (5 * len(a & b) >= 4 * len(a | b) if a or b else True)]
    return [rows[k][0] for k, g in enumerate(roots(len(rows), links)) if g == k]


def edited(rng, text, edits):
    words = text.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("slots", [4, 1 << 20])
def test_near_copies_against_brute_force(spark, monkeypatch, slots):
    monkeypatch.setattr(shingles, "SLOTS", slots)  # any order of rarity gives the same groups
    rng = random.Random(8)
    passage = sentence(rng, 30)
    texts = [sentence(rng, rng.randint(3, 200)) for _ in range(60)]
    texts += [edited(rng, t, k) for t in texts if len(t.split()) > 100 for k in (1, 2, 3, 4, 6)]
    base = sentence(rng, 120)
    texts += [edited(rng, base, rng.choice([1, 1, 2, 3])) for _ in range(100)]  # many are alike only through others
    texts += [passage + " " + sentence(rng, rng.randint(2, 40)) for _ in range(60)]  # one very common passage
    chain = [sentence(rng, 100)]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 1))
    texts += chain + [base.upper(), base + "\n", texts[0], texts[0], "", " \t", None, "one two", "one  Two", "one two three"]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = kept_by_brute_force(rows)
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == want and out.columns == docs.columns
    assert len(want) < len(rows) - 100


def test_near_copies_empty_and_without_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_copies(spark, none, "").count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")]
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1]
