"""Aggregates, sets, ordered operators, rules, retrieval and state on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.operators import filters, ordered, retrieval, rules, state
from revlens.operators import rollups as R

from .base import Book, Tables

book = Book()

SEVERITY = "CASE user_id % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'odd' END"


def _severity():
    s = F.lit(None).cast("string")
    for i, name in enumerate(("critical", "high", "medium", "low", "odd")):
        s = F.when(F.col("user_id") % 6 == i, name).otherwise(s)
    return s


@book.add("""
SELECT l_returnflag, l_linestatus, sum(n)::BIGINT AS n, string_agg(t || ':' || n, ',' ORDER BY t) AS histogram FROM (
  SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS t, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL
""")
def a01_histogram(spark, sf_dir):
    return R.histogram(Tables(spark, sf_dir).lineitem, ["l_returnflag", "l_linestatus"], "l_linenumber")


@book.add("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL)
SELECT user_id, event_type AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS r FROM c) WHERE r = 1
""")
def a02_mode_first_seen(spark, sf_dir):
    return R.mode_first_seen(Tables(spark, sf_dir).events, ["user_id"], "event_type", "event_id")


@book.add(f"""
SELECT date_trunc('hour', ts) AS hour, round(least(greatest(100 - coalesce(sum(CASE s WHEN 'critical' THEN 25.0 WHEN 'high' THEN 15.0 WHEN 'medium' THEN 8.0 WHEN 'low' THEN 3.0 ELSE 5.0 END)
  FILTER (WHERE s IS NOT NULL), 0)::DOUBLE, 0), 100), 2) AS score FROM (SELECT *, {SEVERITY} AS s FROM events) GROUP BY hour
""")
def a03_compliance_score(spark, sf_dir):
    events = Tables(spark, sf_dir).events.withColumn("s", _severity())
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(R.compliance_score(F.col("s")).alias("score"))


@book.add("""
SELECT c_custkey, round(least(greatest(coalesce(avg(o_totalprice / 400000), 0.95), 0), 1), 4) AS confidence
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey
""")
def a04_mean_confidence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(R.mean_confidence(F.col("o_totalprice") / 400000).alias("confidence"))


@book.add(f"""
SELECT user_id, count(*) FILTER (WHERE s = 'critical') AS n_critical, count(*) FILTER (WHERE s = 'high') AS n_high, count(*) FILTER (WHERE s = 'low') AS n_low FROM (SELECT *, {SEVERITY} AS s FROM events) GROUP BY user_id
""")
def a05_session_profile(spark, sf_dir):
    events = Tables(spark, sf_dir).events.withColumn("s", _severity())
    return R.counts_by(events, ["user_id"], "s", ["critical", "high", "low"])


@book.add("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a06_type_counts(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def a07_first_wins(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    return filters.first_by_key(events, ["event_type", "user_id"], ["event_id"]).select("event_type", "user_id", "event_id")


@book.add("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY digest")
def a08_dedupe_digest(spark, sf_dir):
    return R.dedupe_by_digest(Tables(spark, sf_dir).documents, "text", "doc_id")


@book.add("""
WITH j AS (SELECT lang, quality = 1 AS t, n_chars > 1200 AS p FROM labels JOIN documents USING (doc_id)), n AS (
  SELECT lang, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn FROM j GROUP BY lang)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 6) END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) END AS f1 FROM n
""")
def a09_classifier_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.labels.join(t.documents, "doc_id")
    return R.classification_counts(rows, ["lang"], F.col("quality") == 1, F.col("n_chars") > 1200)


@book.add("""
WITH j AS (SELECT lang, quality = 1 AS t, n_chars > 1200 AS p FROM labels JOIN documents USING (doc_id)), n AS (
  SELECT lang, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE t <> p) AS e FROM j GROUP BY lang)
SELECT round(avg(2.0::DOUBLE * tp / (2 * tp + e)), 6) AS macro_f1 FROM n WHERE 2 * tp + e > 0
""")
def a11_macro_f1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = R.classification_counts(t.labels.join(t.documents, "doc_id"), ["lang"], F.col("quality") == 1, F.col("n_chars") > 1200)
    f1 = F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return m.agg(F.round(F.avg(f1), 6).alias("macro_f1"))


@book.add("SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def a13_confusion(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.labels.join(t.documents, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@book.add("""
WITH q AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]{6,}')) AS w FROM benchmark), h AS (
  SELECT item_id, doc_id FROM q JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM documents) USING (w)), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank, doc_id % 3 = 0 AS relevant FROM h), g AS (
  SELECT q.item_id, min(rank) FILTER (WHERE relevant) AS first, count(*) FILTER (WHERE relevant AND rank <= 5) AS rel, count(rank) AS returned FROM q LEFT JOIN r USING (item_id) GROUP BY q.item_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr,
  round(sum(rel)::DOUBLE / sum(least(5, returned)), 6) AS precision_at_k FROM g
""")
def a17_retrieval_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    word = F.lower(F.regexp_extract("text", "[A-Za-z]{6,}", 0))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), word.alias("w"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    hits = t.documents.select("doc_id", F.explode(found).alias("w")).join(queries, "w")
    ranks = retrieval.top_k(hits.select("query_id", "doc_id", F.lit(0).alias("score")), ["query_id"], "doc_id", 1 << 30)
    n = ranks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_returned"))
    relevant = ranks.where("doc_id % 3 = 0").select("query_id", "rank")
    rows = queries.select("query_id").join(n, "query_id", "left").join(relevant, "query_id", "left")
    rows = rows.withColumn("n_returned", F.coalesce("n_returned", F.lit(0)))
    return R.retrieval_metrics(rows, 5, [])


@book.add("""
SELECT round(1 - (SELECT product(greatest(1000 - 10 - i, 0)::DOUBLE / (1000 - i)) FROM range(3) t(i)), 6) AS chance_recall,
  round((SELECT sum(1.0::DOUBLE / i) FROM range(1, 1001) t(i)) / 1000, 6) AS chance_mrr
""")
def a18_chance_floors(spark, sf_dir):
    return spark.range(1).select(R.chance_recall(1000, 10, 3).alias("chance_recall"), R.chance_mrr(1000).alias("chance_mrr"))


@book.add("""
WITH e AS (SELECT p_brand, min(p_size - 0.5) AS x0, max(p_size + 0.5) AS x1, min(p_retailprice - 0.5) AS y0, max(p_retailprice + 0.5) AS y1 FROM part GROUP BY p_brand)
SELECT p_brand, x0 - 0.05::DOUBLE * (x1 - x0) AS xmin, y0 - 0.05::DOUBLE * (y1 - y0) AS ymin, x1 + 0.05::DOUBLE * (x1 - x0) AS xmax, y1 + 0.05::DOUBLE * (y1 - y0) AS ymax FROM e
""")
def a21_bounds(spark, sf_dir):
    part = Tables(spark, sf_dir).part.withColumn("x", F.col("p_size").cast("double"))
    return R.bounds(part, ["p_brand"], "x", "p_retailprice", F.lit(0.5))


@book.add()
def a24_flood_box(spark, sf_dir):
    """Boxes grown over each user's events of a day, in order."""
    events = Tables(spark, sf_dir).events
    points = events.select("user_id", F.col("event_id").alias("ord"), F.hour("ts").cast("double").alias("x"), F.col("value").alias("y"))
    return R.flood_boxes(points, "user_id", 10.0, 24.0, 200.0)


CLUSTERS_SQL = """
WITH RECURSIVE p AS (SELECT s_nationkey, s_suppkey, (s_suppkey % 40)::DOUBLE AS x, s_acctbal / 500 AS y FROM supplier),
e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM p a JOIN p b ON a.s_nationkey = b.s_nationkey AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 8.0),
r(a, b) AS (SELECT s_suppkey, s_suppkey FROM p UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS s_suppkey, min(b) AS cluster FROM r GROUP BY a)
"""


def _clusters(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    points = s.select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 40).cast("double").alias("x"), (F.col("s_acctbal") / 500).alias("y"))
    return R.linked_points(points, "s_nationkey", "s_suppkey", 8.0).withColumnRenamed("node", "s_suppkey")


@book.add(CLUSTERS_SQL + "SELECT * FROM c")
def a25_single_linkage(spark, sf_dir):
    """Clusters of suppliers' places in a nation: components of the graph of points within a radius."""
    return _clusters(spark, sf_dir)


@book.add(CLUSTERS_SQL + """
, n AS (SELECT s_nationkey, cluster, count(*) AS n FROM c JOIN supplier USING (s_suppkey) GROUP BY ALL HAVING count(*) >= 3)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, cluster) = 1
""")
def a26_largest_cluster(spark, sf_dir):
    """Of each nation the largest cluster of three or more."""
    nation = Tables(spark, sf_dir).supplier.select("s_suppkey", "s_nationkey")
    return R.largest_cluster(_clusters(spark, sf_dir).join(nation, "s_suppkey"), ["s_nationkey"], "cluster")


@book.add()
def a29_table_rows(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    cells = events.select("user_id", F.col("event_id").alias("ord"), F.minute("ts").cast("double").alias("x"), F.col("value").alias("y"))
    return R.table_rows(cells, "user_id", 0.5)


@book.add("""
WITH s AS (SELECT s_nationkey, s_acctbal, s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS step FROM supplier),
m AS (SELECT *, max(step) OVER (PARTITION BY s_nationkey) AS largest FROM s), c AS (SELECT *, sum(coalesce((step > 0.25 * largest)::INT, 0)) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal)::BIGINT AS col FROM m)
SELECT s_nationkey, col, round(avg(s_acctbal), 6) AS center, count(*) AS n FROM c GROUP BY ALL
""")
def a30_columns(spark, sf_dir):
    return ordered.columns_by_step(Tables(spark, sf_dir).supplier, ["s_nationkey"], "s_acctbal")


@book.add("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3")
def a34_promoted(spark, sf_dir):
    return R.promoted(Tables(spark, sf_dir).events, ["event_type", "user_id"])


@book.add("""
SELECT lang, round(max(n)::DOUBLE / sum(n), 4) AS baseline, sum(n)::BIGINT AS n FROM (SELECT lang, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY lang
""")
def a33_majority_baseline(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.majority_baseline(t.labels.join(t.documents, "doc_id"), ["lang"], "quality")


@book.add("""
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus <> 'MATCHED') AS n_changed, count(*) FILTER (WHERE l_linestatus = 'MATCHED') AS n_matched,
  CASE WHEN bool_or(l_linestatus <> 'MATCHED') THEN 'CHANGED' ELSE 'MATCHED' END AS status FROM lineitem GROUP BY l_returnflag
""")
def a35_category_rollup(spark, sf_dir):
    return R.category_rollup(Tables(spark, sf_dir).lineitem, ["l_returnflag"], "l_linestatus")


@book.add("SELECT c_custkey, coalesce(round(100 * avg((o_orderstatus = 'F')::INT), 2), 100) AS score FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def a36_matched_share(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(R.matched_share(F.col("o_orderstatus") == "F").alias("score"))


@book.add("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by FROM events")
def a38_superseded(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    return state.superseded(events, ["user_id", "event_type"], ["ts"], "event_id").select("event_id", "superseded_by")


@book.add("""
WITH g AS (SELECT event_type, hour(ts)::INT AS hour, CASE WHEN grouping(event_type) = 0 AND grouping(hour(ts)::INT) = 0 THEN 0 WHEN grouping(event_type) = 0 THEN 1 ELSE 2 END AS level, count(*) AS n
  FROM events GROUP BY GROUPING SETS ((event_type), (hour(ts)::INT), (event_type, hour(ts)::INT)))
SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, event_type NULLS FIRST, hour NULLS FIRST) AS place FROM g QUALIFY place <= 8
""")
def a40_grouping_summary(spark, sf_dir):
    events = Tables(spark, sf_dir).events.select("event_type", F.hour("ts").alias("hour"))
    return R.grouping_summary(events, "event_type", "hour", 8)


@book.add("""
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS canonical, count(*) - 1 AS n_others FROM events GROUP BY ALL HAVING count(*) > 1
""")
def a42_canonical(spark, sf_dir):
    return R.canonical_duplicates(Tables(spark, sf_dir).events, ["user_id", "event_type"], ["ts"], "event_id")


@book.add("""
SELECT coalesce(v::VARCHAR, 'unstamped') AS version, v IS NULL OR v < 10 AS stale, count(*) AS n FROM (SELECT nullif(p_size % 12, 0) AS v FROM part) GROUP BY ALL
""")
def a43_version_histogram(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return R.version_histogram(part, F.nullif(F.col("p_size") % 12, F.lit(0)), 10)


@book.add("""
WITH items AS (SELECT n_nationkey, s, n_nationkey % 2 = 0 AS seen FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer)),
f AS (SELECT c_nationkey AS n_nationkey, c_mktsegment AS s, count(*) AS n, count(*) FILTER (WHERE c_acctbal < -900) AS n_bad FROM customer WHERE c_acctbal < 0 GROUP BY ALL)
SELECT n_nationkey, s, coalesce(n, 0) AS n, coalesce(n_bad, 0) AS n_bad, CASE WHEN n_bad > 0 THEN 'DISCREPANCY' WHEN n > 0 THEN 'PASS' WHEN seen THEN 'NO_SIGNAL' ELSE 'UNCHECKED' END AS verdict
FROM items LEFT JOIN f USING (n_nationkey, s)
""")
def a45_verification_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    segments = F.broadcast(t.customer.select(F.col("c_mktsegment").alias("s")).distinct())  # a taxonomy: five names
    items = t.nation.join(segments).select("n_nationkey", "s", (F.col("n_nationkey") % 2 == 0).alias("seen"))
    found = t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("s"), "c_acctbal")
    return R.verification_matrix(items, found, ["n_nationkey", "s"], "seen", F.col("c_acctbal") < -900)


@book.add("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, CASE WHEN count(*) FILTER (WHERE event_type IN ('purchase', 'click')) > 0 THEN
  round(100.0::DOUBLE * count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type IN ('purchase', 'click')), 4) ELSE 100 END AS rate FROM events GROUP BY user_id
""")
def a46_success_rate(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    done, all_ = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type").isin("purchase", "click"))
    return events.groupBy("user_id").agg(done.alias("done"), F.coalesce(F.round(F.try_divide(100.0 * done, all_), 4), F.lit(100.0)).alias("rate"))


@book.add("""
WITH q AS (SELECT p_brand, list_sort(list(p_retailprice)) AS v, count(*) AS n FROM part GROUP BY p_brand), b AS (SELECT p_brand, n, v[floor(n * 0.25)::INT + 1] AS q1, v[floor(n * 0.75)::INT + 1] AS q3 FROM q)
SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high, count(*) AS n_kept FROM part JOIN b USING (p_brand)
WHERE n < 4 OR p_retailprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1) GROUP BY p_brand
""")
def a47_trimmed_bounds(spark, sf_dir):
    return R.trimmed_bounds(Tables(spark, sf_dir).part, ["p_brand"], "p_retailprice", 0.5)


@book.add("""
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings), q AS (SELECT * FROM n WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_inner_product(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) / (q.norm * n.norm), 6) AS score FROM q JOIN n ON q.vec_id <> n.vec_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5
""")
def w01_cosine_topk(spark, sf_dir):
    vectors = Tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").alias("vec"))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    return ordered.cosine_topk(queries, vectors, 5)


@book.add("""
WITH c AS (SELECT o_custkey, o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), o AS (SELECT o_orderpriority, n AS own FROM c WHERE o_custkey = 1),
d AS (SELECT o_custkey, sum(n * own) AS dot FROM c JOIN o USING (o_orderpriority) GROUP BY o_custkey), m AS (SELECT o_custkey, sqrt(sum(n * n)) AS norm FROM c GROUP BY o_custkey)
SELECT m.o_custkey, coalesce(round(coalesce(dot, 0) / (norm * (SELECT sqrt(sum(own * own)) FROM o)), 4), 0) AS score FROM m LEFT JOIN d USING (o_custkey) WHERE m.o_custkey <> 1
ORDER BY score DESC, m.o_custkey LIMIT 10
""")
def w02_count_map_cosine(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    counts = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return ordered.count_map_cosine(counts, "o_custkey", "o_orderpriority", "n", F.col("o_custkey") == 1, 10)


@book.add("""
WITH a AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer),
b AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS r FROM customer),
s AS (SELECT c_nationkey, c_custkey, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) AS rank FROM s
""")
def w03_rank_fusion(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    by_balance = retrieval.top_k(c.select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("score")), ["c_nationkey"], "c_custkey", 1 << 30)
    by_name = filters.first_by_key(c, ["c_custkey"], ["c_custkey"])
    from pyspark.sql import Window

    by_name = by_name.withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_name", "c_custkey")))
    columns = ["c_nationkey", "c_custkey", "rank"]
    return ordered.reciprocal_rank_fusion([by_balance.select(*columns), by_name.select(*columns)], ["c_nationkey"], "c_custkey")


@book.add("""
WITH d AS (SELECT DISTINCT s_nationkey, round(s_acctbal, 3) AS v FROM supplier), g AS (SELECT s_nationkey, round(v - lag(v) OVER (PARTITION BY s_nationkey ORDER BY v), 3) AS gap FROM d),
l AS (SELECT s_nationkey, list_sort(list(gap)) AS v, count(*) AS n FROM g WHERE gap > 0 GROUP BY s_nationkey)
SELECT s_nationkey, v[n // 2 + 1] AS pitch, n FROM l
""")
def w08_pitch(spark, sf_dir):
    return ordered.pitch(Tables(spark, sf_dir).supplier, ["s_nationkey"], "s_acctbal")


@book.add("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 60000000 AS m, epoch_us(ts) / 60000000 - lag(epoch_us(ts) / 60000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT event_id, sum(coalesce((gap > 30)::INT, 0)) OVER (PARTITION BY user_id ORDER BY m, event_id)::BIGINT AS band FROM e
""")
def w09_banding(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    rows = events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 60000000).alias("m"))
    return ordered.banded(rows, ["user_id"], "m", 30.0, "event_id").select("event_id", "band")


@book.add("SELECT c_nationkey, arg_max(c_acctbal, (c_acctbal, c_custkey)) AS c_acctbal, arg_max(c_custkey, (c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey")
def w11_best_by(spark, sf_dir):
    return ordered.best_by(Tables(spark, sf_dir).customer, ["c_nationkey"], ["c_acctbal"], "c_custkey")


@book.add("""
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN regexp_extract(p_type, '[0-9]+') = '' THEN 1 ELSE 0 END, TRY_CAST(regexp_extract(p_type, '[0-9]+') AS BIGINT) NULLS FIRST, p_type, p_partkey) AS place
FROM part
""")
def w13_natural_sort(spark, sf_dir):
    """All rows by a range-partitioned sort."""
    return ordered.placed(Tables(spark, sf_dir).part, list(ordered.natural_key(F.col("p_type"))), "p_partkey")


@book.add("""
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN regexp_extract(p_type, '[0-9]+') = '' THEN 1 ELSE 0 END, TRY_CAST(regexp_extract(p_type, '[0-9]+') AS BIGINT) NULLS FIRST, p_type, p_partkey) AS place
FROM part
""")
def w13_natural_sort_all(spark, sf_dir):
    """As w13_natural_sort, under the name it had while that one ended at 100 rows."""
    return ordered.placed(Tables(spark, sf_dir).part, list(ordered.natural_key(F.col("p_type"))), "p_partkey")


@book.add("""
SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w IS NULL AS is_latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def w14_revision_chain(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    return ordered.chain(orders, ["o_custkey"], ["o_orderdate"], "o_orderkey").select("o_orderkey", "previous", "is_latest")


@book.add("""
WITH n AS (SELECT event_id, user_id, date_trunc('hour', ts) AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT event_id FROM (SELECT *, max(n) OVER (PARTITION BY user_id, g) AS last FROM n) WHERE last <= 20
""")
def w15_undo_log(spark, sf_dir):
    events = Tables(spark, sf_dir).events.withColumn("g", F.date_trunc("hour", "ts"))
    return ordered.recent_groups(events, ["user_id"], "g", "event_id", 20).select("event_id")


@book.add("""
SELECT id, 'a' AS side FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
SELECT id, 'both' FROM (SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT id, 'b' FROM (SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer)
""")
def u03_set_algebra(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id"))
    parts = ((a.subtract(b), "a"), (a.intersect(b), "both"), (b.subtract(a), "b"))
    out = [p.withColumn("side", F.lit(s)) for p, s in parts]
    return out[0].union(out[1]).union(out[2])


@book.add("""
SELECT id, 'not supplied' AS problem FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 40) WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT p_partkey, 'not cited' FROM part WHERE p_size > 5 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)
""")
def u05_coverage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return state.coverage_check(
        t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("id")), t.part.where("p_size > 5").select(F.col("p_partkey").alias("id")), "id"
    )


@book.add("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def d04_latest_state(spark, sf_dir):
    return state.latest_state(Tables(spark, sf_dir).events, ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@book.add("""
WITH a AS (SELECT user_id, max(event_id) AS va FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 0 GROUP BY user_id), b AS (SELECT user_id, max(event_id) AS vb FROM events WHERE event_id % 2 = 1 AND user_id % 5 <> 0 GROUP BY user_id)
SELECT user_id, va, vb, CASE WHEN vb IS NULL OR va > vb THEN 'a_to_b' WHEN va IS NULL OR vb > va THEN 'b_to_a' ELSE 'none' END AS action FROM a FULL JOIN b USING (user_id)
""")
def s26_lww_sync(spark, sf_dir):
    events = Tables(spark, sf_dir).events

    def side(rows):
        return rows.groupBy("user_id").agg(F.max("event_id").alias("v"))

    a, b = side(events.where("event_id % 2 = 0 and user_id % 7 <> 0")), side(events.where("event_id % 2 = 1 and user_id % 5 <> 0"))
    return state.lww_sync(a, b, "user_id", "v")


@book.add("""
SELECT 'customer' AS level, count(*) AS n FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4))
""")
def d08_cascade(spark, sf_dir):
    t = Tables(spark, sf_dir)
    levels = state.cascade(t.customer, F.col("c_nationkey") == 4, "c_custkey", [(t.orders, "o_custkey", "o_orderkey"), (t.lineitem, "l_orderkey", "l_linenumber")])
    out = [df.agg(F.lit(n).alias("level"), F.count(F.lit(1)).alias("n")) for df, n in zip(levels, ("customer", "orders", "lineitem"), strict=True)]
    return out[0].union(out[1]).union(out[2])


@book.add("""
SELECT p_partkey, coalesce(CASE WHEN p_brand IN ('Brand#11', 'Brand#22') THEN 'own ' || p_brand END, 'standard') AS template FROM part
""")
def d12_resolve_default(spark, sf_dir):
    part = Tables(spark, sf_dir).part.select("p_partkey", "p_brand")
    rows = [("Brand#11", "own Brand#11", False), ("Brand#22", "own Brand#22", False), (None, "standard", True)]
    templates = spark.createDataFrame(rows, "p_brand string, template string, is_default boolean")
    return state.resolve_default(part, templates, "p_brand", "template").select("p_partkey", "template")


@book.add("""
WITH d AS (SELECT p_brand, min(p_size) AS x0, min(p_retailprice) AS y0, max(p_size) AS x1, max(p_retailprice) AS y1 FROM part WHERE p_size > 5 GROUP BY p_brand),
t AS (SELECT p_brand, min(p_size) AS x0, min(p_retailprice) AS y0, max(p_size) AS x1, max(p_retailprice) AS y1 FROM part WHERE p_size BETWEEN 20 AND 30 AND p_brand < 'Brand#30' GROUP BY p_brand)
SELECT coalesce(d.p_brand, t.p_brand) AS p_brand, CASE WHEN d.p_brand = 'Brand#11' THEN least(t.x0, d.x0) ELSE coalesce(t.x0, d.x0) END AS x0, CASE WHEN d.p_brand = 'Brand#11' THEN least(t.y0, d.y0) ELSE coalesce(t.y0, d.y0) END AS y0,
  CASE WHEN d.p_brand = 'Brand#11' THEN greatest(t.x1, d.x1) ELSE coalesce(t.x1, d.x1) END AS x1, CASE WHEN d.p_brand = 'Brand#11' THEN greatest(t.y1, d.y1) ELSE coalesce(t.y1, d.y1) END AS y1,
  CASE WHEN t.p_brand IS NULL THEN 'detected' WHEN d.p_brand IS NULL THEN 'template' ELSE 'both' END AS source FROM d FULL JOIN t ON d.p_brand = t.p_brand
""")
def g07_override_merge(spark, sf_dir):
    part = Tables(spark, sf_dir).part

    def boxes(rows):
        return rows.groupBy("p_brand").agg(
            F.min("p_size").alias("x0"), F.min("p_retailprice").alias("y0"), F.max("p_size").alias("x1"), F.max("p_retailprice").alias("y1")
        )

    template = boxes(part.where("p_size between 20 and 30 and p_brand < 'Brand#30'"))
    return state.override_merge(boxes(part.where("p_size > 5")), template, "p_brand", "Brand#11")


@book.add("""
WITH d AS (SELECT event_id AS subject, row_number() OVER (PARTITION BY user_id, event_type, floor(value) ORDER BY event_id) AS n FROM events),
r AS (SELECT 'duplicate' AS rule, subject::VARCHAR AS subject, n::VARCHAR AS detail, 1 AS place FROM (SELECT * FROM d WHERE n > 1 ORDER BY subject LIMIT 5)
 UNION ALL SELECT 'forbidden type', event_type, count(*)::VARCHAR, 2 FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type
 UNION ALL SELECT 'unbalanced', user_id::VARCHAR, a || '/' || b, 3 FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY user_id) WHERE a > 10 AND b < 10
 UNION ALL SELECT 'no purchase', user_id::VARCHAR, 'missing', 4 FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)
 UNION ALL SELECT 'needs view', user_id::VARCHAR, a::VARCHAR, 5 FROM (SELECT user_id, count(*) FILTER (WHERE value > 80) AS a, count(*) FILTER (WHERE value < 0.1) AS b FROM events GROUP BY user_id) WHERE a > 0 AND b = 0
 UNION ALL SELECT 'negative', event_id::VARCHAR, event_type, 6 FROM events WHERE value < 0)
SELECT * FROM r
""")
def r20_rule_run(spark, sf_dir):
    events = Tables(spark, sf_dir).events.withColumn("whole", F.floor("value"))
    kind, value = F.col("event_type"), F.col("value")
    return rules.run_rules(
        [
            rules.duplicates(events, "duplicate", ["user_id", "event_type", "whole"], "event_id", 5),
            rules.once_per(events, "forbidden type", ~kind.isin("click", "view"), "event_type"),
            rules.unbalanced(events, "unbalanced", "user_id", kind == "click", kind == "purchase", 10, 10),
            rules.missing_in(events, events, "no purchase", "user_id", (kind == "purchase") & (value > 60)),
            rules.present_without(events, "needs view", "user_id", value > 80, value < 0.1),
            rules.violations(events, "negative", value < 0, F.col("event_id"), kind),
        ]
    )


@book.add(r"""
WITH d AS (SELECT doc_id, text FROM documents), r AS (
 SELECT 'thread' AS rule, doc_id::VARCHAR AS subject, regexp_extract(text, '\b([0-9]{3}-[0-9]{4})\b') AS detail FROM d WHERE regexp_matches(text, '\b[0-9]{3}-[0-9]{4}\b')
 UNION ALL SELECT 'callout', doc_id::VARCHAR, 'license' FROM d WHERE contains(text, 'License') AND NOT regexp_matches(text, 'version [0-9]'))
SELECT * FROM r
""")
def r12_regex_rules(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    text, pattern = F.col("text"), r"\b([0-9]{3}-[0-9]{4})\b"
    threads = rules.violations(docs, "thread", text.rlike(pattern), F.col("doc_id"), F.regexp_extract(text, pattern, 1))
    callouts = rules.violations(docs, "callout", text.contains("License") & ~text.rlike("version [0-9]"), F.col("doc_id"), F.lit("license"))
    return threads.union(callouts)


@book.add("""
WITH h AS (SELECT user_id, list_sort(list_filter(['click', 'purchase', 'signup', 'view'], lambda w: NOT list_contains(list(event_type), w))) AS lacking FROM events WHERE value > 40 GROUP BY user_id)
SELECT 'required' AS rule, user_id::VARCHAR AS subject, array_to_string(lacking, ',') AS detail FROM h WHERE len(lacking) > 0
""")
def r08_required_fields(spark, sf_dir):
    events = Tables(spark, sf_dir).events.where("value > 40")
    return rules.required_fields(events, "required", "user_id", "event_type", ["view", "click", "purchase", "signup"])


@book.add("""
WITH f AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_size NOT IN (10, 20, 30, 40, 50))
SELECT 'height' AS rule, p_partkey::VARCHAR AS subject, p_size::VARCHAR AS detail FROM f WHERE n <= 3
""")
def r13_off_standard(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return rules.off_standard(part, "height", F.col("p_size"), [10.0, 20.0, 30.0, 40.0, 50.0], 0.1, F.col("p_partkey"), "p_brand", "p_partkey", 3)


@book.add(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda w: w <> '') AS words FROM documents),
t AS (SELECT doc_id, len(words) AS len, unnest(words) AS term FROM w), a AS (SELECT count(*) AS n_docs, avg(len(words)) AS avg_len FROM w),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda w: w <> '')) AS term FROM benchmark),
p AS (SELECT doc_id, term, len, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), a GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3
""")
def l02_bm25(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return retrieval.bm25(t.documents, t.benchmark, "doc_id", "item_id", "text", 3)


@book.add(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda w: w <> '') AS words FROM documents),
t AS (SELECT doc_id, len(words) AS len, unnest(words) AS term FROM w), a AS (SELECT count(*) AS n_docs, avg(len(words)) AS avg_len FROM w),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-öø-ÿ]+'), lambda w: w <> '')) AS term FROM benchmark),
p AS (SELECT doc_id, term, len, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), a GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3
""")
def l02_bm25_all(spark, sf_dir):
    """As l02_bm25, under the name it had while that one ended at item 20."""
    t = Tables(spark, sf_dir)
    return retrieval.bm25(t.documents, t.benchmark, "doc_id", "item_id", "text", 3)


@book.add()
def l01_tfidf_search(spark, sf_dir):
    """For each benchmark item the most alike turns of conversations by n-gram TF-IDF."""
    t = Tables(spark, sf_dir)
    docs = t.conversations.select(F.struct("conv_id", "turn").alias("key"), "text")
    found = retrieval.tfidf_search(docs, t.benchmark.select("item_id", "text"), "key", "item_id", "text", 3)
    return found.select("item_id", "key.conv_id", "key.turn", "score", "rank")


@book.add("""
SELECT n_nationkey, CASE WHEN enc IS NULL THEN 'MISSING' WHEN n = 0 THEN 'EMPTY' WHEN enc <> 'ngram' THEN 'STALE' ELSE 'OK' END AS status
FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'ngram' WHEN 1 THEN 'old' END AS enc, n_nationkey % 4 AS n FROM nation)
""")
def s25_index_status(spark, sf_dir):
    nation = Tables(spark, sf_dir).nation
    k = F.col("n_nationkey")
    encoder = F.when(k % 3 == 0, "ngram").when(k % 3 == 1, "old")
    return nation.select("n_nationkey", retrieval.index_status("ngram", encoder, k % 4).alias("status"))
