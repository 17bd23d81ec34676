"""The training-data operators against brute force, and their defined results in odd cases."""

import difflib  # noqa: F401
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from revlens.llm import chat, decontam, embed, htmltext, langid, linededup, mixing, quality, queries, simhash, tokens
from revlens.llm.common import Scratch, connected_components, held_out

WORDS = [f"w{i}" for i in range(60)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def roots(n, links):
    """Least node reachable from each."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, Scratch(spark)).collect()}
    want = roots(300, links)
    assert got == {i: want[i] for i in range(300) if want[i] != i}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def fingerprint_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def simhash_want(rows):
    prints = [fingerprint_of(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    groups = roots(len(rows), links)
    least = {}
    for k, g in enumerate(groups):
        least[g] = min(least.get(g, 1 << 60), rows[k][0])
    return sorted((rows[k][0], f"{prints[k]:016x}", least[g]) for k, g in enumerate(groups))


def test_simhash_groups(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(1, 200))) for i in range(60)]
    base = sentence(rng, 400).split()
    for i in range(60, 140):
        other = list(base)
        other[rng.randrange(len(other))] = rng.choice(WORDS)
        rows.append((i, " ".join(other)))
    rows += [(140, None), (141, ""), (142, " \t\n"), (143, "É ß\x0b漢"), (144, rows[3][1].upper()), (145, rows[3][1] + "\x85 x"), (146, "x " * 150_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("rep", F.lit(1))
    got = sorted(tuple(r) for r in simhash.simhash_groups(df).select("doc_id", "fingerprint", "component_id").collect())
    assert got == simhash_want(rows)
    kept = sorted(r.doc_id for r in simhash.simhash_dedup(df).collect())
    assert kept == sorted({c for _, _, c in got})


@pytest.mark.parametrize("most", [1, 64])
def test_simhash_links_keep_components(spark, most):
    """Pairs and midpoints give the same components, whatever the size from which midpoints are used."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for p in list(prints)[:20]:
        for _ in range(12):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, rep long")
    links = [(r.a, r.b) for r in simhash.simhash_links(df, Scratch(spark), most=most).collect()]
    want = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert roots(len(prints), links) == roots(len(prints), want)
    assert {tuple(sorted(x)) for x in links} <= set(want)


def test_simhash_empty(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


LANGS = {"aa": "the of and thing", "bb": "der die und ung", "cc": "les une eau que"}


def lang_rows(rng, n):
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        yield i, " ".join(rng.choice(LANGS[lang].split()) + rng.choice(LANGS[lang].split()) for _ in range(rng.randrange(5, 80))), lang


def test_language_id(spark):
    rng = random.Random(4)
    rows = list(lang_rows(rng, 300)) + [(900, None, "aa"), (901, "123 !!", "bb"), (902, "x", None), (903, rows_long := "theof andthing " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.fit_dictionaries(df.where(~held_out(F.col("doc_id"), 4, 2)))
    assert sorted(learned) == sorted(LANGS)
    got = {r.doc_id: r for r in langid.identify(df, learned).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows[:300] if (__import__("zlib").crc32(str(i).encode()) % 4) == 2]
    assert sum(right) / len(right) >= 0.98
    assert got[903].lang_pred == "aa" and len(rows_long) > 500_000
    for i in (900, 901):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.identify(df, langid.fit_dictionaries(df.where("false"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_id_accuracy(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_embedding_groups(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((30, 16))
    vectors = [c + rng.standard_normal(16) * s for c in centers for s in (0.1, 0.2, 0.3, 0.4, 0.5)]
    vectors += [vectors[0]] * 5
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [float("inf")] + [0.0] * 15), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cid", F.lit(0)).withColumn("kept", F.lit(0))
    got = {r.vec_id: r for r in embed.embedding_groups(df, recall=0.9999).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = roots(len(rows), [tuple(p) for p in np.argwhere(near) if p[0] < p[1]])
    assert [got[i].n_links for i in range(len(rows))] == list(near.sum(1) - 1)
    assert [got[i].component_id for i in range(len(rows))] == want
    assert all(got[i].kept == (i == got[i].component_id) for i in range(len(rows)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)


def test_embedding_blocks(spark, monkeypatch):
    """Buckets cut into blocks give the same links as whole ones."""
    rng = np.random.default_rng(6)
    center = rng.standard_normal(8)
    rows = [(i, [float(np.float32(v)) for v in center + rng.standard_normal(8) * 0.35]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(tuple(r) for r in embed.embedding_groups(df).collect())
    monkeypatch.setattr(embed, "BLOCK", 20)
    assert sorted(tuple(r) for r in embed.embedding_groups(df).collect()) == whole


def test_embedding_recall(spark):
    got = {r.vec_id: r.n_links for r in queries.op3_embedding_dedup(spark, "/root/testdata/sf0.1").collect()}
    rows = queries.table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(got[r.vec_id] for r in rows) >= 0.9 * want.sum()
    assert all(got[r.vec_id] <= w for r, w in zip(rows, want, strict=True))


def test_token_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(7)
    own = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -5.0), ("ba", -4.0), ("bab", -6.0), ("▁ab", -7.0)]
    for pieces in (own, tokens.read_pieces(queries.VOCABULARY)):
        ref = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
        ref.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
        texts = ["", "  \n", "ab  ba\tbab　aab", "q\x1cq zz 漢字漢字 é", "ab" * 3000, "日本" * 50 + " x"]
        texts += ["".join(rng.choice("ab zé") for _ in range(rng.randrange(1, 60))) for _ in range(150)]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
        out = df.withColumn("n_tokens", tokens.token_count(F.col("text"), pieces))
        got = {r.doc_id: r.n_tokens for r in out.collect()}
        assert got == {i: len(ref.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)} | {999: 0}


def line_want(rows):
    lines = [(d, k, line, frozenset(w for w in line.lower().split() if w)) for d, t in sorted(rows) for k, line in enumerate((t or "").split("\n")) if t is not None]
    gone = set()
    for i, (d, k, _, s) in enumerate(lines):
        if s and any(e and len(s & e) >= 0.8 * len(s | e) - 1e-12 for *_, e in lines[:i]):
            gone.add((d, k))
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


def test_line_dedup(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lines = [sentence(rng, rng.randrange(0, 14)) for _ in range(rng.randrange(1, 8))]
        if rows and rng.random() < 0.7:
            words = rng.choice(rng.choice(rows)[1].split("\n")).split()
            if words:
                words[rng.randrange(len(words))] = rng.choice(WORDS)
                lines.append(" ".join(words).upper())
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "tab\tand\x0bodd  blanks"), (104, "TAB and odd blanks"), (105, "w1 " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("clash")).withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: r.text for r in linededup.with_kept_text(df).collect()}
    assert got == line_want(rows)
    seen = linededup.dedup_lines(df)
    assert seen.columns == df.columns
    want = {d for d, t in line_want(rows).items() if t == dict(rows)[d] or (t and t.strip())}
    assert {r.doc_id for r in seen.collect()} == want
    twice = linededup.with_kept_text(df.union(df)).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text) for r in twice} == set(got.items()) and {r["count"] for r in twice} == {2}
    assert linededup.dedup_lines(df.where("false")).count() == 0
    nameless = spark.createDataFrame([(None, rows[5][1]), (None, "words of its own here"), (5, rows[5][1])], df.select("doc_id", "text").schema)
    first = min(rows[5][1].split("\n"), key=lambda x: not x.strip())
    left = {(r.doc_id, r.text): r.n_removed for r in linededup.with_kept_text(nameless).collect()}
    assert left[(None, "words of its own here")] == 0 and sum(1 for d, _ in left if d == 5) == 1 and first is not None


def test_line_dedup_of_very_common_words(spark):
    """Words that occur over 65,536 times are the last in order, and still count as shared."""
    hot = [f"h{k}" for k in range(12)]
    rows = [(0, " ".join(hot + ["one"])), (1, " ".join(hot + ["two"])), (2, " ".join(hot[:9])), (3, " ".join(hot[2:] + ["three"]))]
    filler = [(10 + k, " ".join([w, f"own{k}a", f"own{k}b"] + [w] * 70_000)) for k, w in enumerate(hot)]
    got = linededup.with_kept_text(spark.createDataFrame(rows + filler, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.where("doc_id < 10").collect()} == {0: 0, 1: 1, 2: 0, 3: 0}


def test_line_dedup_large_groups(spark):
    """Near copies of a line in numbers: results are whole, and pairs grow with the group, not its square."""
    rng = random.Random(3)
    bases = [[f"b{g}x{k}" for k in range(n)] for g, n in enumerate((30, 12, 7))]
    rows = []
    for i in range(900):
        words = list(bases[i % 3])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(2000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.with_kept_text(df).where("n_removed = 0")
    assert {r.doc_id for r in got.collect()} == {d for d, t in line_want(rows).items() if t}
    scratch = Scratch(spark)
    classes = linededup.line_classes(df, scratch, 0.8, "doc_id", "text")
    likely = scratch.save(linededup.likely_matches(classes, 0.8))
    assert likely.count() <= 2 * classes.count()
    pairs = linededup.candidates(classes, likely.select("late").distinct(), 0.8).count()
    assert pairs <= 2 * len(rows)


def test_chat_windows(spark):
    rng = random.Random(9)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"])
            rows.append((c, t, role, rng.choice(["", "a<b>\\l c\\\\", sentence(rng, rng.randrange(1, 300)), "</turn> <turn:user>\n"])))
    rows += [(50, 0, None, None), (50, 0, "assistant", None), (51, 1, "assistant", "x"), (51, 1, "assistant", "x"), (None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    out = chat.windows(df, 200, 60).withColumn("turns", chat.read_turns(F.col("formatted"), F.col("repeated")))
    out = out.withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, ro or "", te or "") for c, t, ro, te in rows if c == conv))
        made = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.window)
        assert [(t.role, t.text) for r in made for t in r.turns] == [(ro, te) for *_, ro, te in own]
        assert "".join(r.loss for r in made) == "".join(te for *_, ro, te in own if ro == "assistant")
        if own[0][2] == "system":
            assert all(r.formatted.startswith("<turn:system>") for r in made)
    many = [r for r in out if r.repeated]
    assert many and all(len(r.formatted) > 0 for r in many)
    assert chat.windows(df.where("false")).count() == 0


def test_chat_query_digest(spark):
    got = {r.conv_id: r for r in queries.op6_chat_format(spark, "/root/testdata/sf0.001").collect()}
    hard = "\\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest() and got[-7].loss_chars == len(hard)


def test_decontamination(spark):
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 60)))) for i in range(40)] + [(90, None), (91, "!!"), (None, "x y z")]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))]
        part = rng.choice(items[:40])[1].split()
        for _ in range(rng.randrange(0, 3)):
            part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + part + words[at:]).title()))
    docs += [(500, None), (501, ""), (502, items[5][1] + "! " + items[6][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit("clash")).withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = decontam.Index([x for x in items if x[1] and x[0] is not None], 5, 0.8, 20)
    want = {}
    for d, text in docs:
        words = index.shingler.words(text or "")
        for n, own in index.by_size.items():
            width, size = min(5, n), min(n, len(words))
            h = decontam.Shingler(width).shingles(words) if size >= width else np.zeros(0, np.uint64)
            for item, ih in own:
                best = max((decontam.weighted_similarity(h[s : s + size - width + 1], ih) for s in range(len(words) - size + 1)), default=0) if len(h) else 0
                if best >= 0.8:
                    want[d, item] = best
    for limit in (4_000_000, 2000):  # one slice and several
        out = decontam.with_leaks(df, bench, slice_chars=limit).select("doc_id", F.explode("leaks").alias("l")).collect()
        assert {(r.doc_id, r.l.item_id): r.l.similarity for r in out} == want
    assert len(want) > 40
    clean = {r.doc_id for r in decontam.decontaminate(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_mixing(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["a", "b", "c", "é", None]), sentence(rng, rng.randrange(0, 60))) for i in range(2000)]
    rows += [(5000 + i, "zz", "one two") for i in range(3)] + [(9000, "a", None), (9001, "empty", ""), (9001, "empty", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit("clash")).withColumn("n", F.lit(1))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sorted(mixing.mix(df.repartition(7)).select("doc_id", "copies").collect()) == sorted((r.doc_id, r.copies) for r in out)
    sizes, targets, taken = {}, {}, {}
    for r in out:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 3
        sizes[r.source], targets[r.source] = r.source_size, r.target
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = {s for s in order if not sizes[s]}, sum(sizes.values())
    while True:
        unit = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * unit > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        assert targets[s] == pytest.approx(3 * sizes[s] if s in full else weight[s] * unit)
        assert abs(taken[s] - targets[s]) <= 130
    assert mixing.emit(mixing.mix(df)).count() == sum(r.copies for r in out)
    assert mixing.mix(df.where("false")).count() == 0


def test_quality(spark):
    got = queries.op9_quality(spark, "/root/testdata/sf0.01")
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    pos, neg = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) >= 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.93


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good words here " * 5 if i % 2 else "$$$ ### !!! " * 5) for i in range(40)] + [(90, None), (91, ""), (92, "good words here " * 50_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 1), (3, None), (77, 0)], "doc_id long, quality long")
    out = {r.doc_id: r for r in quality.with_quality(docs, quality.fit(docs, labels)).collect()}
    assert all(out[i].predicted == i % 2 for i in range(40)) and out[92].predicted == 1
    assert out[90].score == out[91].score == pytest.approx(0.5, abs=0.02)
    assert quality.fit(docs, labels.where("false")) is None
    assert {r.score for r in quality.with_quality(docs, None).collect()} == {0.0}


def test_quality_votes_exactly():
    rng = np.random.default_rng(12)
    points = rng.standard_normal((300, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    model = quality.Neighbours(np.ones(1), np.eye(1), points, rng.integers(0, 2, 300).astype(float), 0.4)
    at = points[:20] + 0.01
    got = model.vote(at, 7, 8.0)
    for row, value in zip(at, got, strict=True):
        near = points @ row
        own = np.argsort(-near)[:7]
        weight = np.maximum(near[own], 0) ** 8
        assert value == pytest.approx((weight * model.labels[own]).sum() / weight.sum())


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies on this site, as everyone does nowadays, sadly.</div><div id="main-col"><h1>Head &amp; line</h1>
<p>First   paragraph with <b>bold</b> and <a href=x>a link</a> in it, long enough to count.<p>Second one, not closed; &eacute;t&#233; is a word here.
<script>var x = "<p>no</p>";</script><form><p>Your name</p></form><ul><li>item one is long enough<li>item two is long too</ul></div>
<div class="comments"><p>A reader comment that is rather long, so that it has high density too, yes.</p></div><footer>foot</footer></body></html>"""


def test_html_text(spark):
    want = "Head & line\nFirst paragraph with bold and a link in it, long enough to count.\nSecond one, not closed; été is a word here.\nitem one is long enough\nitem two is long too"
    assert htmltext.extract(PAGE) == want
    odd = ["", None, "no tags  at all", "<p>", "<p>x", "<a>" * 20_000 + "deep", "</b>" * 20_000 + "y", "<!-- never closed", "<script>x", "a < b & c", "<div><p>" + "long text " * 100_000 + "</p></div>"]
    rows = [(i, "u", h) for i, h in enumerate([PAGE, *odd])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in htmltext.with_main_text(df).collect()}
    assert got[0].text == want and all(r.n_chars == len(r.text) for r in got.values())
    assert [got[i + 1].text for i in range(6)] == ["", "", "no tags at all", "", "x", "deep"]
    assert got[7].text == "y" and got[8].text == got[9].text == "" and got[10].text == "a < b & c"
    assert got[11].n_chars == len("long text " * 100_000) - 1


def test_html_pages(spark):
    import html
    import re

    for r in queries.table(spark, "/root/testdata/sf0.001", "pages").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        assert htmltext.extract(r.html) == "\n".join(x for x in parts if x)


def test_language_of_marks_and_copies(spark):
    """Marks alone are no letters; a group of copies doesn't fill the sample; columns of the result's names are replaced."""
    rows = [(i, t, lang) for i, t, lang in lang_rows(random.Random(4), 80)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.fit_dictionaries(docs, sample=20)
    assert learned == langid.fit_dictionaries(docs.dropDuplicates(["text"]), sample=20) or len(learned) == len({r[2] for r in rows})
    odd = spark.createDataFrame([(1, "́̂", "x"), (2, "12", "x"), (3, None, "x"), (4, rows[0][1], "x"), (4, rows[0][1], "x")], "doc_id long, text string, lang_pred string")
    seen = langid.identify(odd.withColumn("score", F.lit("clash")), learned).collect()
    assert [r.lang_pred for r in sorted(seen, key=lambda r: r.doc_id)] == ["und"] * 3 + [rows[0][2]] * 2
    assert langid.fit_dictionaries(docs.where("false")) == {}


def test_unclosed_tags_take_linear_time():
    import time

    for page in ("<a " * 300_000, "<!" * 300_000, "<a \"'" * 200_000 + ">"):
        began = time.perf_counter()
        htmltext.extract(page)
        assert time.perf_counter() - began < 5


def test_mixing_ties_by_size(spark):
    """Rows of one id and source but of different sizes have an order of their own, whatever the partitions."""
    rows = [(1, "s", 10 + i % 3) for i in range(30)] + [(None, None, 5), (None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    taken = [sorted((r.size, r.copies) for r in mixing.mix(d, size_col="words").collect()) for d in (df, df.repartition(7).orderBy(F.rand(3)))]
    assert taken[0] == taken[1]
