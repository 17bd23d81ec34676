"""The corpus pipeline against a plain version of its stages."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from revlens.llm import langid, mixing

from .test_operators import lang_rows, line_want, roots


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls everywhere, an empty table and clashing columns go through all stages without harm."""
    spark.createDataFrame([(None, None), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, stay string, id string, size string, key string"
    odd = [(None, None, None, None, None, "a", "b", "c", "d"), (1, "", "aa", None, 0, None, None, None, None), (2, "x y", "aa", "s", None, "", "", "", "")]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns[:5] == schema.replace(" long", "").replace(" string", "").split(", ")[:5], name
            docs.collect()
    docs = spark.createDataFrame([], schema)
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(20)
    rows = [(i, t, lang, f"s{i % 4}") for i, t, lang in lang_rows(rng, 150)]
    rows += [(200 + k, rows[k][1] + " ofthe", rows[k][2], "s9") for k in range(10)] + [(300, None, "aa", "s1"), (301, "12 34", None, None)]
    passage = " ".join(f"{w}of" * 2 for w in rows[7][1].split()[:20])
    rows.append((310, "andthe ofof " * 9 + "\n" + passage, "aa", "s2"))
    long = [f"{a}{b}" for a in ("the", "of", "and", "to", "in") for b in ("ing", "ed", "ly", "er", "est", "al", "ous", "ic")]
    rows += [(320, " ".join(long), "aa", "s1"), (321, " ".join(long[:-1]), "aa", "s1"), (330, "thetheof andofand", None, "s1"), (330, "thetheof andofand", None, "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    folder = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)

    told = stages["language"](spark, docs, folder)
    assert told.columns == docs.columns
    learned = langid.fit_dictionaries(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    known = {r.doc_id for r in langid.identify(docs, learned, corpus_pipeline.MIN_MARGIN).where("not rejected").collect()}
    assert {r.doc_id for r in told.collect()} == known and not known & {300, 301}

    plain = {r.doc_id: r.text for r in told.collect()}
    out = stages["lines"](spark, told, folder)
    kept = {d: t for d, t in line_want(sorted(plain.items())).items() if t.strip()}
    assert {r.doc_id: r.text for r in out.collect()} == kept and out.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in out.collect())

    single = stages["near_copies"](spark, out, folder)
    ids = sorted(kept)
    sets = [five_words(kept[i]) for i in ids]
    links = [(a, b) for b in range(len(ids)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in single.collect()} == {ids[k] for k, g in enumerate(roots(len(ids), links)) if g == k}
    assert single.columns == docs.columns

    clean = stages["benchmark"](spark, single, folder)
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()}
    assert gone == {r.doc_id for r in single.collect() if passage in r.text.replace("\n", " ")} and gone

    mixed = stages["mixture"](spark, clean, folder)
    want = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want

    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: r["count"] for r in whole.groupBy("doc_id").agg(F.count("*").alias("count")).collect()} == want
