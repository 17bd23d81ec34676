"""Phrase counts and collocations against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import phrases


def plain_counts(rows, max_words):
    """{lang: Counter of phrases}, the empty phrase counts words."""
    out = {}
    for _, text, lang in rows:
        c = out.setdefault(lang or "und", Counter({"": 0}))
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            c[""] += len(words)
            c.update(" ".join(words[i : i + n]) for n in range(1, max_words + 1) for i in range(len(words) - n + 1))
    return out


def plain_collocations(rows, max_words, min_count, top):
    out = []
    for lang, c in plain_counts(rows, max_words).items():
        held = {p: f for p, f in c.items() if p and " " in p and f >= min_count}
        kept = []
        for p, a in held.items():
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and len(q) > len(p) and 100 * f >= 50 * a for q, f in held.items()):
                continue
            cuts = [(1000000 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k, c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, p.encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, c[""], -s))
    return sorted(out)


def sample(rng, n=260):
    vocabulary = ["New", "york", "CITY", "a", "b", "É", "ß漢", "x\x0cy", "r-d", "\x1f", "the"]
    say = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "]) for _ in range(k))
    rows = [(i, say(rng.randrange(0, 60)), rng.choice(["en", "de", None, "und"])) for i in range(n)]
    return rows + [(900, None, "en"), (901, "", "fr"), (902, "one two " * 4000, "xx"), rows[3], rows[3], (903, "New York City. " * 30, "en")]


@pytest.mark.parametrize("shard_bytes,filter_bits", [(8 << 20, 1 << 20), (700, 1 << 12), (300, 64)])
def test_counts_and_collocations(spark, shard_bytes, filter_bits):
    rows = sample(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"phrase": F.lit("p"), "f": F.lit(1), "n": F.lit(2), "rank": F.lit(0)}).repartition(3)
    for max_words in (2, 3, 4):
        want = {(lang, p, f) for lang, c in plain_counts(rows, max_words).items() for p, f in c.items() if f >= 10 or not p}
        got = [tuple(r) for r in phrases.phrase_counts(docs, max_words, 10, shard_bytes=shard_bytes, filter_bits=filter_bits).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    for max_words, top in ((3, 2000), (4, 25), (2, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, max_words, 10, top, shard_bytes=shard_bytes, filter_bits=filter_bits).collect())
        assert got == plain_collocations(rows, max_words, 10, top) and got


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 4, 7):
        x = np.concatenate([rng.integers(0, 4, 500), np.zeros(depth, np.int64)])
        sa = phrases.suffix_array(x, depth)
        cut = [tuple(x[i : i + depth]) + (0,) * (depth - len(x[i : i + depth])) for i in sa]
        assert cut == sorted(cut) and sorted(sa) == list(range(len(x)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " .\n", "en")], "doc_id long, text string, lang string")
    assert phrases.collocations(blank).count() == 0
    assert sorted(tuple(r) for r in phrases.phrase_counts(blank).collect()) == [("en", "", 0), ("und", "", 0)]


def test_products_beyond_64_bits(spark):
    """Counts that no small corpus has, through the scoring alone."""
    a, l, r = 9 * 10**13, 10**14 + 7, 9 * 10**13 + 1  # noqa: E741
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(
        "(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s"
    )
    assert got.first().s == 1000000 * a * a // (l * r)
