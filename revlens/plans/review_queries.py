"""Reviews, scores, records, rules and drawing scalars on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import drawing as D
from revlens.functions import geometry as G
from revlens.functions import text as X
from revlens.operators import filters, matching, records, review, rollups, rules, scoring, state

from .base import Book, Tables

book = Book()
SHEET = (0.0, 900.0, 50.0, 2000.0)


@book.add("""
SELECT p_partkey FROM part WHERE (p_size BETWEEN 5 AND 15 AND p_retailprice BETWEEN 900 AND 1300) OR (p_size BETWEEN 30 AND 45 AND p_retailprice BETWEEN 1200 AND 1700)
""")
def f07_in_any_shape(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    shapes = [((5, 900, 15, 1300), None), ((30, 1200, 45, 1700), None)]
    return part.where(G.in_any_shape(F.col("p_size"), F.col("p_retailprice"), shapes)).select("p_partkey")


@book.add("""
SELECT p_partkey, coalesce(nullif(p_size, 13) BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950 AND 1400, false) AS inside FROM part
""")
def f08_insert_in_zone(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    held = G.in_box(F.nullif(F.col("p_size"), F.lit(13)), F.col("p_retailprice"), (10, 950, 20, 1400))
    return part.select("p_partkey", F.coalesce(held, F.lit(False)).alias("inside"))


@book.add("""
SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 45 AND NOT (p_size BETWEEN 10 AND 12 AND p_retailprice BETWEEN 900 AND 1200) AND NOT (p_size BETWEEN 40 AND 44 AND p_retailprice BETWEEN 1000 AND 1900)
""")
def f11_exclusions(spark, sf_dir):
    """What a zone may hold when all others of a region map are excluded."""
    part = Tables(spark, sf_dir).part
    regions = {"title": (10, 900, 12, 1200), "notes": (40, 1000, 44, 1900), "views": (5, 900, 45, 2100)}
    shapes = [(box, None) for name, box in regions.items() if name != "views"]
    x, y = F.col("p_size"), F.col("p_retailprice")
    return part.where(x.between(5, 45) & ~G.in_any_shape(x, y, shapes)).select("p_partkey")


@book.add("""
WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN chr(64 + p_size) WHEN p_partkey % 3 = 1 THEN chr(9311 + p_size) ELSE p_size::VARCHAR END AS text FROM part),
l AS (SELECT *, regexp_matches(trim(text), '^([A-H]|0*[1-9]|0*1[0-2])$|[①-⑫]') AND NOT (p_size BETWEEN 4.5 AND 45.5 AND p_retailprice BETWEEN 999.0 AND 1901.0) AS label FROM p)
SELECT p_partkey, label, label OR NOT (p_size BETWEEN 1.25 AND 48.75 AND p_retailprice BETWEEN 927.5 AND 1972.5) AS margin FROM l
""")
def f12_margin_grid(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    x, y = F.col("p_size"), F.col("p_retailprice")
    key = F.col("p_partkey") % 3
    circled = F.get(F.array(*[F.lit(chr(9311 + k)) for k in range(1, 51)]), x.cast("int") - 1)
    text = F.when(key == 0, F.char(64 + x)).when(key == 1, circled).otherwise(x.cast("string"))
    return part.select("p_partkey", D.grid_label(text, x, y, SHEET).alias("label"), D.in_margin(text, x, y, SHEET).alias("margin"))


@book.add("""
WITH b AS (SELECT p_brand, min(p_size) AS x0, min(p_retailprice) AS y0, max(p_size) AS x1, max(p_retailprice) AS y1 FROM part GROUP BY p_brand)
SELECT p_brand, (x1 - x0) * (y1 - y0) / 55000.0 > 0.7 AS too_large FROM b
""")
def f14_area_guard(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    box = [F.min("p_size"), F.min("p_retailprice"), F.max("p_size"), F.max("p_retailprice")]
    boxes = part.groupBy("p_brand").agg(*[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])
    return boxes.select("p_brand", D.too_large(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), SHEET).alias("too_large"))


@book.add("""
WITH z AS (SELECT p_partkey, p_size BETWEEN 1 AND 20 AS tol, p_retailprice BETWEEN 900 AND 1100 AS upper_left, p_size BETWEEN 15 AND 30 AS title FROM part)
SELECT p_partkey FROM z WHERE NOT ((tol OR upper_left) AND NOT title)
""")
def f18_keep_for_title(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    tolerance, upper, title = F.col("p_size").between(1, 20), F.col("p_retailprice").between(900, 1100), F.col("p_size").between(15, 30)
    return part.where(~((tolerance | upper) & ~title)).select("p_partkey")


@book.add("""
SELECT p_partkey, CASE WHEN len(list_intersect(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), ['brass', 'steel'])) > 0 THEN true ELSE false END AS furniture FROM part
""")
def f19_layer_tokens(spark, sf_dir):
    """Whole tokens of a layer's name decide, not parts of them."""
    part = Tables(spark, sf_dir).part
    tokens = F.split(F.lower("p_type"), "[^a-z0-9]+")
    return part.select("p_partkey", F.arrays_overlap(tokens, F.array(F.lit("brass"), F.lit("steel"))).alias("furniture"))


@book.add("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC
""")
def f28_optional_conjuncts(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    rows = review.listing(orders, "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "F", None, F.col("o_custkey") % 3 == 1)
    return rows.select("o_orderkey")


@book.add("SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3 OR nullif(o_custkey % 7, 0) IS NULL ORDER BY o_orderdate DESC, o_orderkey DESC")
def f25_list_newest(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders.withColumn("owner", F.nullif(F.col("o_custkey") % 7, F.lit(0)))
    return review.listing(filters.mine(orders, "owner", 3), "o_orderdate", "o_orderkey").select("o_orderkey")


@book.add("""
SELECT event_id, 'live' AS list FROM events WHERE coalesce(CASE WHEN value > 90 THEN true WHEN value > 80 THEN NULL ELSE false END, false) = false
UNION ALL SELECT event_id, 'trash' FROM events WHERE value > 90
""")
def f26_live_and_trash(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    gone = F.when(F.col("value") > 90, True).when(F.col("value") > 80, F.lit(None)).otherwise(False)
    live = filters.live(events, gone).select("event_id", F.lit("live").alias("list"))
    return live.union(events.where(gone).select("event_id", F.lit("trash")))


@book.add("SELECT DISTINCT p_brand FROM part WHERE p_size = 7 ORDER BY p_brand")
def f31_distinct_layers(spark, sf_dir):
    return Tables(spark, sf_dir).part.where("p_size = 7").select("p_brand").distinct().orderBy("p_brand")


@book.add("""
SELECT event_id FROM events WHERE event_type = 'click' AND nullif(user_id % 4, 0) IS NOT DISTINCT FROM NULL AND nullif(floor(value), 3) IS NOT NULL
""")
def f34_dismissal_scope(spark, sf_dir):
    """Equal text and verb, the same client (or none on both sides), not retracted."""
    events = Tables(spark, sf_dir).events
    client = F.nullif(F.col("user_id") % 4, F.lit(0))
    rows = events.where((F.col("event_type") == "click") & client.eqNullSafe(F.lit(None).cast("long")))
    return rows.where(F.nullif(F.floor("value"), F.lit(3)).isNotNull()).select("event_id")


@book.add("""
SELECT event_id, user_id FROM events WHERE user_id % 2 = 0 AND (value <= 50) ORDER BY ts, event_id
""")
def f35_markings(spark, sf_dir):
    events = Tables(spark, sf_dir).events.withColumn("retracted_at", F.when(F.col("value") > 50, F.col("ts")))
    return records.unretracted(events, "retracted_at").where("user_id % 2 = 0").orderBy("ts", "event_id").select("event_id", "user_id")


@book.add("SELECT doc_id, coalesce(nullif(trim(coalesce(nullif(source, ''), nullif(lang, ''), '')), ''), '') AS text FROM documents")
def f37_text_of(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    return docs.select("doc_id", D.text_of(F.col("source"), F.col("lang")).alias("text"))


@book.add("""
WITH e AS (SELECT user_id, value, event_id FROM events), z AS (SELECT unnest([{n: 'wide', a: 0, b: 100}, {n: 'mid', a: 20, b: 80}, {n: 'small', a: 40, b: 60}]) AS z)
SELECT event_id, min_by(z.n, z.b - z.a) AS zone FROM e LEFT JOIN z ON value BETWEEN z.a AND z.b GROUP BY event_id
""")
def f42_smallest_zone(spark, sf_dir):
    """The smallest of the zones that hold a place."""
    events = Tables(spark, sf_dir).events
    zones = [("wide", 100, (0, 100)), ("mid", 60, (20, 80)), ("small", 20, (40, 60))]
    held = [(name, area, F.col("value").between(*span)) for name, area, span in zones]
    return events.select("event_id", filters.owner(F.col("value"), F.col("value"), held).alias("zone"))


@book.add("""
SELECT a.event_id AS event_id, count(b.event_id) AS peers FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type
  AND nullif(floor(a.value), 5) IS NOT DISTINCT FROM nullif(floor(b.value), 5) AND a.event_id <> b.event_id GROUP BY a.event_id
""")
def f41_peers(spark, sf_dir):
    """Peers on three keys, one of which may be null on both sides: counted by groups, not pairs."""
    events = Tables(spark, sf_dir).events.withColumn("kind", F.nullif(F.floor("value"), F.lit(5)))
    n = events.groupBy("user_id", "event_type", "kind").agg((F.count(F.lit(1)) - 1).alias("peers"))
    on = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_type") == F.col("b.event_type")) & F.col("a.kind").eqNullSafe(F.col("b.kind"))
    return events.alias("a").join(n.alias("b"), on).select("event_id", "peers")


FOUND_SQL = """
WITH lab AS (SELECT l_orderkey * 10 + l_linenumber AS label_id, l_orderkey % 50 AS pair_id, CASE WHEN l_linenumber = 3 THEN '' ELSE (l_partkey % 40)::VARCHAR END AS handle,
    l_returnflag || (l_suppkey % 9) AS text, l_linenumber <> 4 AS resolved, l_returnflag AS kind FROM lineitem),
found AS (SELECT o_orderkey AS found_id, o_orderkey % 50 AS pair_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_custkey % 40)::VARCHAR END AS handle,
    substr('ANR', (o_custkey % 3 + 1)::INT, 1) || (o_orderkey % 9) AS text, substr('ANR', (o_orderkey % 3 + 1)::INT, 1) AS kind FROM orders),
h AS (SELECT label_id, found_id, 'handle' AS tier FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, handle ORDER BY label_id) AS n FROM lab WHERE handle <> '') a
  JOIN (SELECT *, row_number() OVER (PARTITION BY pair_id, handle ORDER BY found_id) AS n FROM found WHERE handle <> '') b USING (pair_id, handle, n)),
x AS (SELECT label_id, found_id, 'text' AS tier FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, text ORDER BY label_id) AS n FROM lab WHERE label_id NOT IN (SELECT label_id FROM h)) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY pair_id, text ORDER BY found_id) AS n FROM found WHERE found_id NOT IN (SELECT found_id FROM h)) b USING (pair_id, text, n)),
m AS (SELECT * FROM h UNION ALL SELECT * FROM x)
"""


def _scored(spark, sf_dir):
    t = Tables(spark, sf_dir)
    labels = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label_id"), (F.col("l_orderkey") % 50).alias("pair_id"),
        F.when(F.col("l_linenumber") == 3, "").otherwise((F.col("l_partkey") % 40).cast("string")).alias("handle"),
        F.concat("l_returnflag", F.col("l_suppkey") % 9).alias("text"), (F.col("l_linenumber") != 4).alias("resolved"), F.col("l_returnflag").alias("kind"),
    )
    flag = F.array(*map(F.lit, "ANR"))
    found = t.orders.select(
        F.col("o_orderkey").alias("found_id"), (F.col("o_orderkey") % 50).alias("pair_id"),
        F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 40).cast("string")).alias("handle"),
        F.concat(F.get(flag, F.col("o_custkey") % 3), F.col("o_orderkey") % 9).alias("text"), F.get(flag, F.col("o_orderkey") % 3).alias("kind"),
    )
    return labels, found, scoring.tiered_matches(labels, found)


@book.add(FOUND_SQL + "SELECT * FROM m")
def j23_tiered_scoring(spark, sf_dir):
    return _scored(spark, sf_dir)[2]


@book.add(FOUND_SQL + """
, k AS (SELECT * FROM lab WHERE label_id IN (SELECT label_id FROM m)), r AS (SELECT * FROM found WHERE found_id NOT IN (SELECT found_id FROM m)),
d AS (SELECT found_id FROM r WHERE EXISTS (SELECT 1 FROM k WHERE k.pair_id = r.pair_id AND ((k.handle <> '' AND k.handle = r.handle) OR k.text = r.text)))
SELECT 'matched' AS kind, label_id AS id FROM m UNION ALL SELECT CASE WHEN resolved THEN 'missed' ELSE 'unresolvable' END, label_id FROM lab WHERE label_id NOT IN (SELECT label_id FROM m)
UNION ALL SELECT 'duplicate', found_id FROM d UNION ALL SELECT 'spurious', found_id FROM r WHERE found_id NOT IN (SELECT found_id FROM d)
""")
def u06_outcomes(spark, sf_dir):
    """Missed, unresolvable, duplicate and spurious, besides what matched."""
    return scoring.outcomes(*_scored(spark, sf_dir))


@book.add(FOUND_SQL + """
SELECT CASE WHEN resolved THEN kind ELSE '<unresolved>' END AS kind, count(*) FILTER (WHERE label_id IN (SELECT label_id FROM m)) AS tp, count(*) FILTER (WHERE label_id NOT IN (SELECT label_id FROM m)) AS fn,
  round(count(*) FILTER (WHERE label_id IN (SELECT label_id FROM m)) / count(*), 6) AS recall FROM lab GROUP BY 1
""")
def a12_recall_by_type(spark, sf_dir):
    labels, _, matches = _scored(spark, sf_dir)
    known = labels.join(matches.select("label_id", F.lit(True).alias("hit")).distinct(), "label_id", "left")
    kind = known.withColumn("kind", F.when(F.col("resolved"), F.col("kind")))
    return scoring.recall_by(kind, "kind", F.coalesce("hit", F.lit(False)))


@book.add(FOUND_SQL + """
, c AS (SELECT lab.kind AS expected, found.kind AS given, count(*) AS n FROM m JOIN lab USING (label_id) JOIN found USING (found_id) GROUP BY ALL)
SELECT expected, given, n, round((SELECT sum(n) FROM c WHERE expected = given) / (SELECT sum(n) FROM c), 6) AS accuracy FROM c
""")
def a14_attribution(spark, sf_dir):
    labels, found, matches = _scored(spark, sf_dir)
    pairs = matches.join(labels.select("label_id", F.col("kind").alias("expected")), "label_id")
    pairs = pairs.join(found.select("found_id", F.col("kind").alias("given")), "found_id")
    return scoring.attribution(pairs, "expected", "given")


@book.add(FOUND_SQL + "SELECT tier, count(*) AS n FROM m GROUP BY tier")
def a15_tier_histogram(spark, sf_dir):
    return _scored(spark, sf_dir)[2].groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@book.add("""
WITH n AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) FILTER (WHERE l_quantity > 25) AS tp, count(*) FILTER (WHERE l_quantity > 60) AS fp, count(*) FILTER (WHERE l_quantity BETWEEN 50 AND 90 AND l_returnflag = 'A') AS fn FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM n)
SELECT flag, status, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM s
""")
def a10_scores(spark, sf_dir):
    q = F.col("l_quantity")
    n = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.count_if(q > 25).alias("tp"), F.count_if(q > 60).alias("fp"), F.count_if(q.between(50, 90) & (F.col("l_returnflag") == "A")).alias("fn")
    )
    p, r, f1 = scoring.scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select("flag", "status", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@book.add("""
SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS human, count(*) FILTER (WHERE toxic = 1) AS held_out, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS zero_finding, bool_and(quality IS NOT NULL) AS complete FROM labels
""")
def a16_corpus_status(spark, sf_dir):
    q, x = F.col("quality"), F.col("toxic")
    return scoring.corpus_status(Tables(spark, sf_dir).labels, {"human": q == 1, "held_out": x == 1, "zero_finding": (q == 0) & (x == 0)}, q.isNotNull())


@book.add("SELECT n, round((SELECT sum(1.0::DOUBLE / i) FROM range(1, n + 1) t(i)) / n, 6) AS mrr FROM (VALUES (1), (5), (40)) v(n)")
def a19_chance_mrr(spark, sf_dir):
    out = None
    for n in (1, 5, 40):
        row = spark.range(1).select(F.lit(n).alias("n"), rollups.chance_mrr(n).alias("mrr"))
        out = row if out is None else out.union(row)
    return out


@book.add("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, count(*) FILTER (WHERE event_type = 'never') AS n_never FROM events GROUP BY user_id
""")
def a48_zero_counts(spark, sf_dir):
    return rollups.counts_by(Tables(spark, sf_dir).events, ["user_id"], "event_type", ["click", "purchase", "never"])


@book.add("""
WITH s AS (SELECT 'documents' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'none', 0)
SELECT collection, n, CASE WHEN n = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM s
""")
def a20_census(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = None
    for name, df in (("documents", t.documents), ("benchmark", t.benchmark), ("pages", t.pages), ("none", t.pages.where("false"))):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("collection"), "n", F.when(F.col("n") == 0, "EMPTY").otherwise("OK").alias("status"))
        out = row if out is None else out.union(row)
    return out


@book.add("""
WITH l AS (SELECT user_id, event_type AS verdict, event_id, floor(value)::BIGINT AS text FROM events), s AS (SELECT text, max_by(verdict, event_id) AS verdict FROM l GROUP BY text), n AS (SELECT verdict, count(*) AS n FROM s GROUP BY verdict)
SELECT verdict, n, round(n / (SELECT sum(n) FROM n), 6) AS share, (SELECT min(n) / sum(n) FROM n) >= 0.1 AS enough FROM n
""")
def a32_label_sets(spark, sf_dir):
    events = Tables(spark, sf_dir).events.select("event_id", F.col("event_type").alias("verdict"), F.floor("value").alias("text"))
    return records.balance(records.settled_labels(events, "text", "verdict", "event_id"), "verdict", 0.1)


@book.add("""
SELECT c AS category, coalesce(n, 0) AS n, coalesce(changed, 0) AS changed, CASE WHEN coalesce(changed, 0) > 0 THEN 'CHANGED' ELSE 'MATCHED' END AS status
FROM (SELECT unnest(['click', 'purchase', 'signup', 'view', 'notes', 'other']) AS c) LEFT JOIN (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 99) AS changed FROM events GROUP BY 1) ON c = event_type
""")
def a37_six_categories(spark, sf_dir):
    """All six categories, those without rows too; one change makes a category changed."""
    events = Tables(spark, sf_dir).events
    names = spark.createDataFrame([(c,) for c in ("click", "purchase", "signup", "view", "notes", "other")], "category string")
    n = events.groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 99).alias("changed"))
    rows = names.join(n, "category", "left").na.fill(0)
    return rows.withColumn("status", F.when(F.col("changed") > 0, "CHANGED").otherwise("MATCHED"))


@book.add("SELECT user_id, count(*) FILTER (WHERE value <= 50) AS n_live FROM events GROUP BY user_id")
def a39_recount(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.count_if(F.col("value") <= 50).alias("n_live"))


@book.add("""
SELECT v AS event_type, coalesce(live, 0) AS live, coalesce(retracted, 0) AS retracted, greatest(2600 - coalesce(live, 0), 0) AS lacking FROM (SELECT unnest(['click', 'view', 'never']) AS v)
LEFT JOIN (SELECT event_type, count(*) FILTER (WHERE value <= 20) AS live, count(*) FILTER (WHERE NOT value <= 20) AS retracted FROM events GROUP BY 1) ON v = event_type
""")
def a41_shortfall(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    return review.shortfall(events, ["click", "view", "never"], "event_type", F.col("value") > 20, 2600)


@book.add("SELECT p_brand, min(p_size) AS x0, min(p_retailprice) AS y0, max(p_size) AS x1, max(p_retailprice) AS y1 FROM part WHERE p_size > 3 GROUP BY p_brand")
def a22_sheet_bounds(spark, sf_dir):
    part = Tables(spark, sf_dir).part.where("p_size > 3")
    return part.groupBy("p_brand").agg(F.min("p_size").alias("x0"), F.min("p_retailprice").alias("y0"), F.max("p_size").alias("x1"), F.max("p_retailprice").alias("y1"))


@book.add("""
WITH a AS (SELECT p_brand, p_size AS item_no, p_type AS part_name, p_partkey FROM part WHERE p_size > 20), d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY p_brand, item_no ORDER BY p_partkey) = 1),
b AS (SELECT p_brand, p_size AS item_no, p_name AS part_name, p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM a))
SELECT p_brand, item_no, part_name FROM d UNION ALL SELECT p_brand, item_no, part_name FROM b
""")
def a28_bom_rows(spark, sf_dir):
    """Rows from block attributes, the first of each item number; texts only for sheets that have none."""
    part = Tables(spark, sf_dir).part
    blocks = part.where("p_size > 20").select("p_brand", F.col("p_size").alias("item_no"), F.col("p_type").alias("part_name"), "p_partkey")
    first = blocks.groupBy("p_brand", "item_no").agg(F.min_by("part_name", "p_partkey").alias("part_name"))
    rest = part.join(blocks.select("p_brand").distinct(), "p_brand", "left_anti")
    return first.union(rest.select("p_brand", F.col("p_size"), "p_name"))


BOM_SQL = """
WITH o AS (SELECT p_brand, p_size AS item_no, min(p_type) AS name, sum(p_partkey) % 5 AS qty FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), n AS (SELECT p_brand, p_size AS item_no, min(p_type) AS name, sum(p_partkey) % 5 AS qty FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
"""


def _boms(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return [
        part.where(F.col("p_partkey") % 2 == k).groupBy("p_brand", F.col("p_size").alias("item_no")).agg(F.min("p_type").alias("name"), (F.sum("p_partkey") % 5).alias("qty"))
        for k in (0, 1)
    ]


@book.add(BOM_SQL + """
SELECT p_brand, item_no, CASE WHEN o.name IS NULL THEN 'ADDED' WHEN n.name IS NULL THEN 'REMOVED' WHEN cells > 0 THEN 'CHANGED' ELSE 'MATCHED' END AS status, CASE WHEN o.name IS NULL OR n.name IS NULL THEN '' ELSE changed END AS changed
FROM (SELECT p_brand, item_no, o, n, (o.name <> n.name)::INT + (o.qty <> n.qty)::INT AS cells, concat_ws(',', CASE WHEN o.name <> n.name THEN 'name' END, CASE WHEN o.qty <> n.qty THEN 'qty' END) AS changed
  FROM (SELECT o, p_brand, item_no FROM o) FULL JOIN (SELECT n, p_brand, item_no FROM n) USING (p_brand, item_no))
""")
def j09_bom_findings(spark, sf_dir):
    """One finding for each item: all changed cells of a row together."""
    old, new = (df.alias(a) for df, a in zip(_boms(spark, sf_dir), "on", strict=True))
    both = old.join(new, ["p_brand", "item_no"], "full_outer")
    changed = F.concat_ws(",", *[F.when(F.col(f"o.{c}") != F.col(f"n.{c}"), c) for c in ("name", "qty")])
    status = F.when(F.col("o.name").isNull(), "ADDED").when(F.col("n.name").isNull(), "REMOVED").when(changed != "", "CHANGED").otherwise("MATCHED")
    return both.select("p_brand", "item_no", status.alias("status"), changed.alias("changed"))


@book.add(BOM_SQL + """
SELECT f AS field, o.v AS old, n.v AS new, CASE WHEN o.v IS NULL AND n.v IS NULL THEN 'MATCHED' WHEN o.v IS NULL THEN 'ADDED' WHEN n.v IS NULL THEN 'REMOVED' WHEN o.v = n.v THEN 'MATCHED' ELSE 'CHANGED' END AS status
FROM (SELECT unnest(['Brand#11', 'Brand#22', 'Brand#33', 'Brand#99']) AS f) LEFT JOIN (SELECT p_brand, max(name) AS v FROM o WHERE item_no < 40 GROUP BY 1) o ON f = o.p_brand LEFT JOIN (SELECT p_brand, max(name) AS v FROM n WHERE item_no > 10 GROUP BY 1) n ON f = n.p_brand
""")
def j10_title_fields(spark, sf_dir):
    """Fields of a fixed list on both sides, those on neither too."""
    old, new = _boms(spark, sf_dir)
    fields = spark.createDataFrame([(f,) for f in ("Brand#11", "Brand#22", "Brand#33", "Brand#99")], "field string")
    sides = [df.where(w).groupBy(F.col("p_brand").alias("field")).agg(F.max("name").alias("value")) for df, w in ((old, "item_no < 40"), (new, "item_no > 10"))]
    return review.in_both(*[fields.join(s, "field", "left") for s in sides], "field", "value")


@book.add("""
SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 1 AND (p_brand, p_size) NOT IN (SELECT (p_brand, p_size) FROM part WHERE p_partkey % 2 = 0)
""")
def j11_new_issues(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return review.new_issues(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), ["p_brand", "p_size"])


@book.add(r"""
WITH r AS (SELECT p_partkey, unnest(range(CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size % 4 END)) AS i, p_retailprice FROM part) SELECT p_partkey, [i * 10.0, p_retailprice][1] AS x, p_retailprice AS y,
  coalesce((MAP {'critical': '#ff0000', 'high': '#ff8800'})[severity], '#888888') AS colour FROM r JOIN (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'critical' WHEN p_size < 30 THEN 'high' ELSE 'odd' END AS severity FROM part) USING (p_partkey)
""")
def g13_overlay(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    n = F.col("p_size") % 4
    places = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(i * 10.0, F.col("p_retailprice"))))
    severity = F.when(F.col("p_size") < 10, "critical").when(F.col("p_size") < 30, "high").otherwise("odd")
    rows = part.withColumn("severity", severity)
    return review.overlay(rows, "p_partkey", places, "severity", {"critical": "#ff0000", "high": "#ff8800"}, "#888888").drop("severity")


@book.add("""
SELECT user_id, sum(n)::VARCHAR || ' event' || CASE WHEN sum(n) = 1 THEN '' ELSE 's' END || ' (' || string_agg(event_type || ': ' || n, ', ' ORDER BY event_type) || ')' AS summary
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
""")
def l20_summary(spark, sf_dir):
    return review.counts_text(Tables(spark, sf_dir).events, "user_id", "event_type", "event")


@book.add(r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), m AS (SELECT doc_id, list_filter(list_transform(lines, lambda l: regexp_extract(trim(l), '(?i)(?:^|[^\p{L}\p{N}_])(?:REV|revision)\.?\s*([A-Z0-9]+)(?:$|[^\p{L}\p{N}_])', 1)), lambda x: x <> '') AS found FROM t)
SELECT doc_id, coalesce(found[-1], 'A') AS letter, CASE WHEN coalesce(found[-1], 'A') = 'A' AND doc_id % 2 = 0 THEN 'B' ELSE coalesce(found[-1], 'A') END AS advanced FROM m
""")
def g06_revision_letter(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    letter = D.revision_letter(F.split("text", "\n"), "A")
    return docs.select("doc_id", letter.alias("letter"), D.advanced_revision(F.lit("A"), letter, F.col("doc_id") % 2 == 0).alias("advanced"))


@book.add("SELECT p_partkey, CASE WHEN p_type LIKE '%scale%' OR p_size = 7 THEN 'ISO 5455' ELSE 'internal' END AS standard FROM part")
def g12_standard(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    kind = F.when(F.col("p_type").contains("scale") | (F.col("p_size") == 7), "scale_ratio").otherwise("other")
    return part.select("p_partkey", F.when(kind == "scale_ratio", "ISO 5455").otherwise("internal").alias("standard"))


@book.add(r"""
SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'ignore previous|license|worthless|system prompt|password')
""")
def g18_denied_phrases(spark, sf_dir):
    phrases = ["ignore previous", "License", "worthless", "system prompt", "password"]
    return filters.keyword_search(Tables(spark, sf_dir).documents, "text", phrases).select("doc_id")


@book.add("""
SELECT z.n AS zone, count(*) AS n FROM part, (SELECT unnest([{n: 'title', x0: 1, x1: 20, y0: 900, y1: 1200}, {n: 'notes', x0: 10, x1: 35, y0: 1000, y1: 1500}]) AS z) WHERE p_size BETWEEN z.x0 AND z.x1 AND p_retailprice BETWEEN z.y0 AND z.y1 GROUP BY 1
""")
def g16_zones_of_point(spark, sf_dir):
    """All zones that hold a place, not just the owner."""
    part = Tables(spark, sf_dir).part
    x, y = F.col("p_size"), F.col("p_retailprice")
    zones = {"title": (1, 900, 20, 1200), "notes": (10, 1000, 35, 1500)}
    held = F.filter(F.array(*[F.when(G.in_box(x, y, box), name) for name, box in zones.items()]), F.isnotnull)
    return part.select(F.explode(held).alias("zone")).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT event_id FROM events WHERE event_id IN (3, 5, 8)")
def d01_by_id(spark, sf_dir):
    """Rows by id; an id that isn't a number finds nothing."""
    ids = spark.createDataFrame([("3",), ("5",), ("x9",), ("8",)], "id string").select(F.expr("try_cast(id as bigint)").alias("event_id"))
    return Tables(spark, sf_dir).events.join(F.broadcast(ids), "event_id", "left_semi").select("event_id")  # a request's ids


@book.add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 7")
def d02_by_session(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.where("l_orderkey = 7").select("l_orderkey", "l_linenumber")


@book.add(r"""
WITH d AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '[CHANGED] ' ELSE '' END || p_name AS description, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS severity FROM part)
SELECT p_partkey, coalesce(nullif(regexp_extract(description, '^\[([A-Z_]+)\]', 1), ''), severity) AS status FROM d
""")
def d03_finding_status(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    described = F.concat(F.when(F.col("p_size") % 3 == 0, "[CHANGED] ").otherwise(""), F.col("p_name"))
    return part.select("p_partkey", review.finding_status(described, F.when(F.col("p_size") > 25, "high").otherwise("low")).alias("status"))


@book.add("""
SELECT event_id, CASE WHEN user_id = 7 AND value <= 50 THEN 1 WHEN value > 50 THEN 0 END AS retracted FROM events
""")
def d07_retract(spark, sf_dir):
    """A second retraction keeps the first one's time."""
    events = Tables(spark, sf_dir).events.withColumn("retracted", F.when(F.col("value") > 50, 0))
    return review.retract(events, F.col("user_id") == 7, "retracted", F.lit(1)).select("event_id", "retracted")


@book.add("SELECT 'kept' AS what, count(*) AS n FROM events WHERE NOT value > 80 UNION ALL SELECT 'purged', count(*) FROM events WHERE value > 80")
def d06_purge(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    return events.groupBy(F.when(F.col("value") > 80, "purged").otherwise("kept").alias("what")).agg(F.count(F.lit(1)).alias("n"))


@book.add("""
WITH n AS (SELECT p_brand, p_size, max_by(p_name, p_partkey) AS p_name FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL), c AS (SELECT p_brand, p_size, min(p_name) AS p_name FROM part GROUP BY ALL)
SELECT p_brand, p_size, coalesce(n.p_name, c.p_name) AS p_name FROM c LEFT JOIN n USING (p_brand, p_size)
""")
def d10_upsert(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    current = part.groupBy("p_brand", "p_size").agg(F.min("p_name").alias("p_name"))
    return review.upsert(current, part.where("p_partkey % 3 = 0"), ["p_brand", "p_size"], "p_partkey")


@book.add("SELECT p_partkey, p_partkey = 5 AS is_default, CASE WHEN p_partkey = 6 THEN false ELSE p_size = 10 END AS after_unset, p_size = 10 AS after_unknown FROM part")
def d11_set_default(spark, sf_dir):
    part = Tables(spark, sf_dir).part.select("p_partkey", (F.col("p_size") == 10).alias("f"))
    chosen = review.set_default(part, "p_partkey", 5, "f").withColumnRenamed("f", "is_default")
    unset = review.set_default(part, "p_partkey", 6, "f", on=False).withColumnRenamed("f", "after_unset")
    unknown = review.set_default(part, "p_partkey", -1, "f").withColumnRenamed("f", "after_unknown")
    return chosen.join(unset, "p_partkey").join(unknown, "p_partkey")


@book.add("""
SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 AND (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderkey % 2 = 0)
""")
def d13_open_or_resume(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    keys = ["o_custkey", "o_orderpriority"]
    return state.insert_absent(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1").select(*keys), keys)


@book.add("""
WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'submitted' ELSE 'open' END AS status, 0 AS amended FROM orders), p AS (SELECT min(o_orderkey) AS k FROM s WHERE status = 'submitted' AND o_orderkey = 7), g AS (SELECT o_custkey FROM s JOIN p ON o_orderkey = k)
SELECT o_orderkey, CASE WHEN o_custkey IN (FROM g) AND o_orderkey = 7 THEN 'open' WHEN o_custkey IN (FROM g) AND status = 'open' THEN 'closed' ELSE status END AS status, CASE WHEN o_custkey IN (FROM g) AND o_orderkey = 7 THEN 1 ELSE 0 END AS amended FROM s
""")
def d14_reopen(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    rows = orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "submitted").otherwise("open").alias("status"), F.lit(0).alias("amended"))
    return review.reopen(rows, "o_orderkey", 7, "o_custkey", "status", "amended").drop("o_custkey")


@book.add("""
WITH a AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 5)::VARCHAR END AS handle, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 5.0::DOUBLE ELSE value END AS x FROM events)
SELECT a.event_id, CASE WHEN a.handle <> '' OR b.handle <> '' THEN a.handle = b.handle ELSE a.event_type = b.event_type AND (coalesce(abs(a.x - b.x) <= 0.01, a.x IS NULL AND b.x IS NULL)) END AS same FROM a JOIN a b ON b.event_id = a.event_id + 3
""")
def d15_same_entity(spark, sf_dir):
    events = Tables(spark, sf_dir).events.select(
        "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 5).cast("string")).alias("handle"),
        F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 2 == 0, 5.0).otherwise(F.col("value")).alias("x"),
    )
    pairs = events.alias("a").join(events.alias("b"), F.col("b.event_id") == F.col("a.event_id") + 3)

    def address(side):
        return {"handle": F.col(f"{side}.handle"), "type": F.col(f"{side}.event_type"), "x": F.col(f"{side}.x"), "y": F.lit(0.0), "parent": F.lit(None).cast("string"), "layer": F.lit(""), "text": F.lit("")}

    return pairs.select("a.event_id", review.same_entity(address("a"), address("b")).alias("same"))


@book.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def d22_orphans(spark, sf_dir):
    return Tables(spark, sf_dir).orders.where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@book.add("SELECT p_brand, x0 + greatest((x1 - x0 - 30.0) / 2, 0) AS x0, x1 - greatest((x1 - x0 - 30.0) / 2, 0) AS x1 FROM (SELECT p_brand, min(p_size) AS x0, max(p_size) AS x1 FROM part WHERE p_size > 8 GROUP BY 1)")
def d29_clamp(spark, sf_dir):
    boxes = Tables(spark, sf_dir).part.where("p_size > 8").groupBy("p_brand").agg(F.min("p_size").alias("x0"), F.max("p_size").alias("x1"))
    low, high = G.clamp_to_cap(F.col("x0"), F.col("x1"), 30.0)
    return boxes.select("p_brand", low.alias("x0"), high.alias("x1"))


@book.add("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'drift' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0
""")
def d34_checksums(spark, sf_dir):
    from revlens.sources import files

    docs = Tables(spark, sf_dir).documents.select("doc_id", F.md5("text").alias("digest"))
    found = docs.where("doc_id % 5 <> 0").withColumn("digest", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("digest")))
    return files.checksums(docs, found, "doc_id", "digest")


@book.add("SELECT doc_id FROM labels WHERE toxic = 0")
def d37_human_only(spark, sf_dir):
    rows = Tables(spark, sf_dir).labels.withColumn("origin", F.when(F.col("toxic") == 1, "synthetic").otherwise(F.lit(None).cast("string")))
    return records.human_only(rows, "origin").select("doc_id")


@book.add(r"""
SELECT DISTINCT l.category, l.rule FROM (SELECT source AS category, unnest(regexp_extract_all(text, '(?m)^([A-Z][a-z]+ [a-z]+) ', 1)) AS rule FROM documents) l
""")
def d40_learned_rules(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    rules_ = F.regexp_extract_all("text", F.lit(r"(?m)^([A-Z][a-z]+ [a-z]+) "), F.lit(1))
    return docs.select(F.col("source").alias("category"), F.explode(rules_).alias("rule")).distinct()


@book.add("""
SELECT nation.n_name AS name, c_mktsegment AS segment, count(*) AS n, list_sort(list(c_custkey)) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
""")
def d45_nested_report(spark, sf_dir):
    """One document a nation and segment with its customers nested, as a report nests all its findings."""
    t = Tables(spark, sf_dir)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("name"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("c_custkey")).alias("customers"))


@book.add("SELECT event_id, CASE WHEN user_id % 10 = 1 AND value > 10 THEN 'revoked' WHEN value > 10 THEN 'active' ELSE 'ended' END AS status FROM events")
def d46_revoke(spark, sf_dir):
    events = Tables(spark, sf_dir).events.withColumn("status", F.when(F.col("value") > 10, "active").otherwise("ended"))
    hit = (F.col("user_id") % 10 == 1) & (F.col("status") == "active")
    return events.select("event_id", F.when(hit, "revoked").otherwise(F.col("status")).alias("status"))


@book.add("""
SELECT * FROM (SELECT 'removed' AS side, * FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 10 EXCEPT SELECT p_type FROM part WHERE p_size > 45)) UNION ALL SELECT 'added', * FROM (SELECT DISTINCT p_type FROM part WHERE p_size > 45 EXCEPT SELECT p_type FROM part WHERE p_size < 10)
""")
def u01_both_differences(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    diff = matching.hash_set_diff(part.where("p_size < 10"), part.where("p_size > 45"), "p_type").where("status <> 'unchanged'")
    return diff.select(F.when(F.col("status") == "deleted", "removed").otherwise("added").alias("side"), "p_type")


@book.add("SELECT p_type FROM part WHERE p_size < 10 UNION SELECT p_type FROM part WHERE p_size > 45 ORDER BY 1")
def u02_key_union(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return part.where("p_size < 10").select("p_type").union(part.where("p_size > 45").select("p_type")).distinct().orderBy("p_type")


@book.add("SELECT 'universal' AS scope, p_partkey FROM part WHERE p_size < 10 UNION ALL SELECT 'client', p_partkey FROM part WHERE p_brand = 'Brand#11'")
def u04_universal_first(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    universal = part.where("p_size < 10").select(F.lit("universal").alias("scope"), "p_partkey")
    return universal.union(part.where("p_brand = 'Brand#11'").select(F.lit("client"), "p_partkey"))


@book.add(r"""
WITH t AS (SELECT l_suppkey, trim(CASE l_partkey % 4 WHEN 0 THEN ' m' || l_orderkey || 'a' || l_linenumber WHEN 1 THEN 'C' || l_partkey || 'P' WHEN 2 THEN 'see M' || l_orderkey ELSE 'M' || l_linenumber END) AS text FROM lineitem)
SELECT l_suppkey, list_sort(list(DISTINCT upper(text))) AS tokens FROM t WHERE length(text) >= 5 AND regexp_matches(text, '(?i)^[A-Z][0-9]{3,6}[A-Z0-9]{0,6}$') GROUP BY l_suppkey
""")
def u07_identity_tokens(spark, sf_dir):
    """Texts of each supplier's lines that are drawing numbers as a whole."""
    k = F.col("l_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit(" m"), "l_orderkey", F.lit("a"), "l_linenumber")).when(k == 1, F.concat(F.lit("C"), "l_partkey", F.lit("P"))).when(k == 2, F.concat(F.lit("see M"), "l_orderkey")).otherwise(F.concat(F.lit("M"), "l_linenumber"))
    said = Tables(spark, sf_dir).lineitem.select("l_suppkey", F.upper(F.btrim(text)).alias("t")).where(F.col("t").rlike(r"^[A-Z][0-9]{3,6}[A-Z0-9]{0,6}$") & (F.char_length("t") >= 5))
    return said.distinct().groupBy("l_suppkey").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


@book.add("""
WITH n AS (SELECT p_brand, min(p_size) AS v FROM part WHERE p_size > 10 GROUP BY 1), o AS (SELECT p_brand, max(p_size) AS v, p_brand < 'Brand#15' AS aligned FROM part WHERE p_brand <> 'Brand#55' GROUP BY 1)
SELECT coalesce(n.p_brand, o.p_brand) AS p_brand, CASE WHEN o.aligned OR n.v IS NULL THEN o.v ELSE n.v END AS v, CASE WHEN o.aligned OR n.v IS NULL THEN 'old' ELSE 'new' END AS side FROM n FULL JOIN o ON n.p_brand = o.p_brand
""")
def u08_two_sided_zones(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    new = part.where("p_size > 10").groupBy("p_brand").agg(F.min("p_size").alias("v"))
    old = part.where("p_brand <> 'Brand#55'").groupBy("p_brand").agg(F.max("p_size").alias("v"))
    return review.two_sided(new, old, "p_brand", F.col("p_brand") < "Brand#15")


@book.add("""
WITH h AS (SELECT o_custkey AS query, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT query, o_orderkey, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM h JOIN orders USING (o_orderkey) WHERE rank <= 8 AND o_orderstatus = 'F' QUALIFY place <= 2
""")
def w10_scoped_topk(spark, sf_dir):
    from pyspark.sql import Window

    orders = Tables(spark, sf_dir).orders
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = orders.select(F.col("o_custkey").alias("query"), "o_orderkey", rank.alias("rank"))
    found = records.scoped_hits(hits, orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "query", "rank", F.col("o_orderstatus") == "F", 2)
    return found.select("query", "o_orderkey", "place")


@book.add("""
SELECT o_custkey AS query, min(CASE WHEN o_orderstatus = 'F' THEN rank END) AS first_rank, coalesce(bool_or(o_orderstatus = 'F' AND rank <= 3), false) AS hit, count(*) FILTER (WHERE o_orderstatus = 'F' AND rank <= 3) AS n_relevant
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) GROUP BY 1
""")
def w16_first_relevant(spark, sf_dir):
    from pyspark.sql import Window

    orders = Tables(spark, sf_dir).orders
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = orders.select(F.col("o_custkey").alias("query"), "o_orderstatus", rank.alias("rank"))
    return scoring.first_relevant(hits, "query", "rank", F.col("o_orderstatus") == "F", 3)


@book.add("""
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5
""")
def w12_prior_sessions(spark, sf_dir):
    from pyspark.sql import Window

    orders = Tables(spark, sf_dir).orders
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return orders.withColumn("n", n).where("n <= 5").select("o_custkey", "o_orderkey")


@book.add("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size % 3 = 1 THEN p_size END AS x FROM part")
def x12_first_point(spark, sf_dir):
    size = F.col("p_size")
    first = F.when(size % 3 == 0, F.col("p_retailprice"))
    return Tables(spark, sf_dir).part.select("p_partkey", D.first_point(first, F.when(size % 3 == 1, size.cast("double"))).alias("x"))


@book.add("SELECT p_partkey, round(least(greatest(p_size / 50.0 * 1.3, 0.1), 1.0), 4) AS confidence FROM part")
def x22_calibrated(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", D.calibrated(F.col("p_size") / 50.0, F.lit(1.3)).alias("confidence"))


@book.add("SELECT p_partkey, p_size + 2.5::DOUBLE * 0.6::DOUBLE * length(p_name) / 2 AS x, p_retailprice + 1.25 AS y FROM part")
def x24_anchor(spark, sf_dir):
    x, y = D.marker_anchor(F.col("p_size"), F.col("p_retailprice"), F.lit(2.5), F.col("p_name"))
    return Tables(spark, sf_dir).part.select("p_partkey", x.alias("x"), y.alias("y"))


@book.add("SELECT p_partkey, format('aspect-{:.3f}', (p_retailprice + 0.0003137) / p_size) AS signature FROM part")
def x26_sheet_signature(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", G.sheet_signature(F.col("p_retailprice") + 0.0003137, F.col("p_size")).alias("signature"))


@book.add("""
SELECT p_partkey, round(100 + 0.5 * ((p_size - 25) * cos(0.3) - (p_retailprice - 1000) * sin(0.3)), 6) AS x, round(200 + 0.5 * ((p_size - 25) * sin(0.3) + (p_retailprice - 1000) * cos(0.3)), 6) AS y, p_size::DOUBLE AS back FROM part
""")
def x27_view_transform(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    view = ((25.0, 1000.0), 0.5, 0.3, (100.0, 200.0))
    x, y = D.to_view(F.col("p_size"), F.col("p_retailprice"), *view)
    back = D.from_view(x, y, *view)[0]
    return part.select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(back, 6).alias("back"))


@book.add("""
WITH w AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 2 THEN -3 ELSE p_size END AS own, p_size % 4 * 25 AS layer, -3 AS block, CASE p_size % 3 WHEN 0 THEN 256 WHEN 1 THEN 0 ELSE p_size % 12 END AS c FROM part)
SELECT p_partkey, CASE WHEN own IN (-1, -2) THEN layer / 100.0 WHEN own = -3 THEN 0.25 ELSE own / 100.0 END AS mm,
  coalesce((MAP {1: '#ff0000', 2: '#ffff00', 3: '#00ff00', 4: '#00ffff', 5: '#0000ff', 6: '#ff00ff', 7: '#ffffff', 8: '#808080', 9: '#c0c0c0'})[CASE c WHEN 256 THEN 3 WHEN 0 THEN 5 ELSE c END], '#000000') AS colour FROM w
""")
def x29_line_attributes(spark, sf_dir):
    size = F.col("p_size")
    own = F.when(size % 5 == 0, -1).when(size % 5 == 1, -2).when(size % 5 == 2, -3).otherwise(size)
    colour = F.when(size % 3 == 0, 256).when(size % 3 == 1, 0).otherwise(size % 12)
    return Tables(spark, sf_dir).part.select(
        "p_partkey", D.line_weight_mm(own, size % 4 * 25).alias("mm"), D.stroke_colour(colour, F.lit(3), F.lit(5)).alias("colour")
    )


@book.add("SELECT p_partkey, list_transform(CASE WHEN p_size % 2 = 0 THEN [1.0::DOUBLE, 0.5::DOUBLE] ELSE [2.0::DOUBLE] END, lambda d: d * p_size) AS dashes FROM part")
def d42_dashes(spark, sf_dir):
    own = F.when(F.col("p_size") % 2 == 0, F.array(F.lit(1.0), F.lit(0.5)))
    return Tables(spark, sf_dir).part.select("p_partkey", D.dash_pattern(own, F.array(F.lit(2.0)), F.col("p_size")).alias("dashes"))


@book.add()
def x01_normal_key(spark, sf_dir):
    """The key of every document's text."""
    return Tables(spark, sf_dir).documents.select("doc_id", X.normal_key(F.col("text")).alias("key"))


@book.add("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE 'dim:' || (l_linenumber & 7) || ':' || regexp_replace(format('{:.6f}', l_discount), '\\.?0+$', '') END AS key FROM lineitem
""")
def x11_dimension_key(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem
    measure = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount"))
    return lines.select("l_orderkey", "l_linenumber", X.dimension_key(F.col("l_linenumber"), measure, F.col("l_returnflag")).alias("key"))


@book.add(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'phone' WHEN regexp_matches(text, '@') THEN 'mail' WHEN regexp_matches(text, 'License') THEN 'license' ELSE 'plain' END AS kind FROM documents WHERE text IS NOT NULL
""")
def x17_first_rule(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.where("text is not null")
    kinds = [("[0-9]{3}-[0-9]{4}", "phone"), ("@", "mail"), ("License", "license")]
    return docs.select("doc_id", X.first_rule(F.col("text"), kinds, "plain").alias("kind"))


@book.add("SELECT doc_id, regexp_replace(trim(text), '[^A-Za-z0-9._-]+', '_', 'g') AS shown, length(trim(text)) >= 30 AND regexp_matches(trim(text), '[.!?]$') AS sentence FROM documents WHERE text IS NOT NULL")
def x21_sentences(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.where("text is not null")
    t = F.trim("text")
    return docs.select("doc_id", X.safe_name(F.col("text")).alias("shown"), ((F.length(t) >= 30) & t.rlike("[.!?]$")).alias("sentence"))


@book.add("""
SELECT p_partkey, abs(p_size - 25)::DOUBLE AS nearest FROM part
""")
def j22_path_distance(spark, sf_dir):
    """Distance from an upright path that runs past all places."""
    path = F.array(*[F.struct(F.lit(25.0).alias("x"), F.lit(y).alias("y")) for y in (0.0, 1000.0, 5000.0)])
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(G.path_distance(F.col("p_size"), F.col("p_retailprice"), path), 6).alias("nearest"))


@book.add(r"""
SELECT 'scale' AS rule, p_partkey::VARCHAR AS subject, '1:' || p_size AS detail FROM part WHERE p_size NOT IN (1, 2, 5, 10, 20, 50)
""")
def r04_scale(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return rules.off_scale(part, "scale", F.concat(F.lit("Scale : 1 : "), F.col("p_size")), F.col("p_partkey"))


@book.add("""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_retailprice > 0 AND NOT p_retailprice / (p_size * 40.0::DOUBLE) BETWEEN 0.95 AND 1.05 AND p_retailprice <> round_even(p_size * 40.0::DOUBLE, 0))
SELECT 'measure' AS rule, p_partkey::VARCHAR AS subject, round(p_retailprice, 3)::VARCHAR AS detail FROM w WHERE n <= 2
""")
def r05_measure(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return rules.off_measure(part, "measure", F.col("p_retailprice"), F.col("p_size") * 1.0, F.lit(40.0), "p_brand", "p_partkey")


@book.add("""
SELECT 'placeholder' AS rule, p_partkey::VARCHAR AS subject, CASE p_size % 4 WHEN 0 THEN 'see N/A' WHEN 1 THEN ' ' ELSE '-----' END AS detail FROM part WHERE p_size % 4 < 3 AND p_size > 10
""")
def r07_placeholder(spark, sf_dir):
    size = F.col("p_size")
    text = F.when(size % 4 == 0, "see N/A").when(size % 4 == 1, " ").when(size % 4 == 2, "-----").otherwise(F.lit("TBD"))
    return rules.placeholders(Tables(spark, sf_dir).part, "placeholder", text, size > 10, F.col("p_partkey"))


@book.add("""
SELECT 'attribute' AS rule, p_partkey::VARCHAR AS subject, a AS detail FROM (SELECT p_partkey, unnest(['brand', 'size']) AS a, p_size FROM part) WHERE a = 'size' AND p_size % 3 = 0
""")
def r09_empty_attribute(spark, sf_dir):
    size = F.col("p_size")
    attributes = F.create_map(
        F.lit("brand"), F.when(size % 2 != 0, F.col("p_brand")), F.lit("size"), F.when(size % 3 == 0, "  ").otherwise(size.cast("string"))
    )
    return rules.empty_attributes(Tables(spark, sf_dir).part, "attribute", attributes, F.col("p_partkey"))


@book.add("SELECT 'orphan' AS rule, doc_id::VARCHAR AS subject, '' AS detail FROM documents WHERE trim(coalesce(text, '')) = '' OR doc_id % 11 = 0")
def r10_orphan_text(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    text = F.when(F.col("doc_id") % 11 != 0, F.trim("text"))
    return rules.violations(docs, "orphan", F.coalesce(text, F.lit("")) == "", F.col("doc_id"), F.lit(""))


@book.add("SELECT 'thread' AS rule, p_partkey::VARCHAR AS subject, 'M' || p_size AS detail FROM part WHERE p_size < 30")
def r16_thread(spark, sf_dir):
    text = F.concat(F.lit("M"), F.col("p_size"), F.when(F.col("p_size") >= 30, " x 1.5").otherwise(""))
    return rules.too_short_for(Tables(spark, sf_dir).part, "thread", text, r"(?i)(?U)\b(M\s*\d+)\b", 4, F.col("p_partkey"))


@book.add("""
SELECT 'no note' AS rule, user_id::VARCHAR AS subject, 'missing' AS detail FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 30)
UNION ALL SELECT 'no cloud', user_id::VARCHAR, a::VARCHAR FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view' AND value > 70) AS a, count(*) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY 1) WHERE a > 0 AND b = 0
UNION ALL SELECT 'no roughness', user_id::VARCHAR, a::VARCHAR FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click' AND value > 50) AS a, count(*) FILTER (WHERE event_type = 'click' AND value < 5) AS b FROM events GROUP BY 1) WHERE a > 0 AND b = 0
UNION ALL SELECT 'few', user_id::VARCHAR, a || '/' || b FROM (SELECT user_id, count(*) AS a, count(*) FILTER (WHERE event_type = 'signup') AS b FROM events GROUP BY 1) WHERE a > 10 AND b < 2
UNION ALL SELECT 'units', event_id::VARCHAR, '-1' FROM events WHERE floor(value) = 1
""")
def r03_sheet_rules(spark, sf_dir):
    """The forms of rules on what a group lacks - a note, a companion, enough of a kind, a known unit - on events; the drafting rules proper are queries of their own."""
    events = Tables(spark, sf_dir).events
    kind, value = F.col("event_type"), F.col("value")
    return rules.missing_in(events, events, "no note", "user_id", (kind == "signup") & (value > 30)).union(
        rules.present_without(events, "no cloud", "user_id", (kind == "view") & (value > 70), kind == "purchase")
    ).union(
        rules.present_without(events, "no roughness", "user_id", (kind == "click") & (value > 50), (kind == "click") & (value < 5))
    ).union(rules.unbalanced(events, "few", "user_id", F.lit(True), kind == "signup", 10, 2)).union(
        rules.violations(events, "units", F.floor(value) == 1, F.col("event_id"), F.lit("-1"))
    )


@book.add("""
SELECT 'unknown' AS rule, p_brand AS subject, count(*)::VARCHAR AS detail FROM part WHERE p_brand > 'Brand#40' GROUP BY p_brand
UNION ALL SELECT 'double', p_partkey::VARCHAR, n::VARCHAR FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part QUALIFY n > 1 ORDER BY p_partkey LIMIT 5)
""")
def r01_layers(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return rules.once_per(part, "unknown", F.col("p_brand") > "Brand#40", "p_brand").union(rules.duplicates(part, "double", ["p_brand", "p_size"], "p_partkey", 5))


@book.add("""
SELECT doc_id::VARCHAR AS id, trim(text) AS text, CASE WHEN quality = 1 THEN 'reviewed' ELSE 'raw' END AS source, CASE WHEN toxic = 1 THEN 'yes' END AS toxic FROM documents JOIN labels USING (doc_id) WHERE length(trim(text)) > 0 AND doc_id % 3 <> 0
""")
def l06_records(spark, sf_dir):
    """Records of rows that aren't retracted; the source follows the state of review."""
    t = Tables(spark, sf_dir)
    rows = t.documents.join(t.labels, "doc_id").withColumn("retracted", F.when(F.col("doc_id") % 3 == 0, 1))
    source = F.when(F.col("quality") == 1, "reviewed").otherwise("raw")
    made = records.as_records(records.unretracted(rows, "retracted"), F.col("doc_id"), F.col("text"), source, toxic=F.when(F.col("toxic") == 1, "yes"))
    return made.select("id", "text", "source", F.try_element_at("metadata", F.lit("toxic")).alias("toxic"))


@book.add("""
WITH l AS (SELECT doc_id, source || '/' || lang || '/' || n_chars AS section FROM documents) SELECT section AS query, min(doc_id) AS relevant FROM l WHERE section <> '' GROUP BY section HAVING count(*) = 1
""")
def l11_heading_labels(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents.withColumn("section", F.concat_ws("/", "source", "lang", F.col("n_chars").cast("string")))
    docs = docs.withColumn("section", F.when(F.col("source").isNotNull() & F.col("lang").isNotNull(), F.col("section")))
    return records.heading_labels(docs, "doc_id", "section")


@book.add("""
WITH s AS (SELECT p_type AS text, p_partkey FROM part WHERE p_partkey % 10 = 0), n AS (SELECT p_type AS text, p_partkey FROM part WHERE p_partkey % 10 = 1 AND p_size > 5)
SELECT text, p_partkey FROM s UNION ALL SELECT text, min(p_partkey) FROM n WHERE lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM s) GROUP BY text
""")
def l12_query_store(spark, sf_dir):
    part = Tables(spark, sf_dir).part.select(F.col("p_type").alias("text"), "p_partkey", F.when(F.col("p_size") > 5, "log").alias("origin"))
    stored = records.add_queries(part.where("p_partkey % 10 = 0"), part.where("p_partkey % 10 = 1"), "text", "p_partkey", "origin")
    return stored.select("text", "p_partkey")


@book.add("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS turn FROM labels) SELECT doc_id, quality, (turn % 3)::INT AS fold FROM r
""")
def l14_folds(spark, sf_dir):
    return scoring.folds(Tables(spark, sf_dir).labels.select("doc_id", "quality"), "doc_id", "quality")
