"""URL verdicts against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from revlens.llm import queries, urls
from revlens.llm.common import Scratch

RULES = queries.URL_RULES


def plain(url, listed, rules):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        best = max(fits, key=lambda r: len(r[1]) + len(r[2]))
        return host, path, best[1] + best[2], best[0]
    labels = host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels))} | ({host + path} if path else set()) if host else set()
    return host, path, None, "block" if keys & listed else "allow"


@pytest.mark.parametrize("most_bits", [urls.MOST_BITS, 1024])
def test_judged_as_by_a_loop(spark, most_bits):
    rng = random.Random(5)
    names = [f"{a}{b}.example.{tld}" for a in ("", "www.", "M.") for b in range(150) for tld in ("org", "com", "net")]
    rows = [(i, f"https://{rng.choice(names)}/{rng.choice(['es', 'en', 'fr', 'de', 'EN'])}/{rng.randrange(30)}{rng.choice(['', '?a=/b', '#x?y', '/'])}") for i in range(3000)]
    odd = [None, "", "no scheme", "://", "x://", "http://ORG", "http://org/", "http://org?x", "a://b://c/d", "http://ÄÉ.org/ß", "http://notorg/", "http://x.org\n/es/\n1?", "http://example.org/en/12/" + "x" * 100_000, "http://a..b/", "http:///p"]
    rows += [(9000 + i, u) for i, u in enumerate(odd)] * 2
    listed = {f"{b}.example.net" for b in range(0, 150, 4)} | {f"{b}.example.net/en/{b % 30}" for b in range(1, 150, 2)} | {"nowhere.example", "b"}
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("listed", F.lit(1)).withColumn("key", F.lit("k"))
    names = spark.createDataFrame([(k, 1) for k in sorted(listed)] + [(None, 1)], "k string, n int")
    got = urls.judge_urls(pages, names, RULES, most_bits=most_bits)
    assert got.columns == ["page_id", "url", "listed", "key", "host", "path", "rule", "verdict"]
    want = sorted(((i, *plain(u, listed, RULES)) for i, u in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == want
    assert {v for *_, r, v in want if r is None} == {"allow", "block"}


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    scratch = Scratch(spark)
    cascade = urls.build_cascade(scratch.save(keys), scratch)
    assert len(cascade.sizes) >= 3 and cascade.sizes[0] > cascade.sizes[-1]
    told = keys.withColumn("w", cascade.filters.scalar()).select("listed", cascade.has(F.col("key"), F.col("w")).alias("said"))
    assert told.where("listed <> said").count() == 0 and told.count() == 20_000


def test_no_list_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    nothing = spark.createDataFrame([], "key string")
    assert [tuple(r) for r in urls.judge_urls(pages, nothing, RULES).collect()] == [(1, "http://a.com/x", "a.com", "/x", None, "allow")]
    assert urls.judge_urls(pages.where("false"), nothing).count() == 0
    everything = spark.createDataFrame([("com",)], "key string")
    assert urls.judge_urls(pages, everything, RULES).first().verdict == "block"


def test_plan_has_no_join_and_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/x")], "page_id long, url string")
    plan = urls.judge_urls(pages, spark.createDataFrame([("a.com",)], "key string"), RULES)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
