"""Joins and matching on the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from revlens.functions.text import ratio, shared_characters
from revlens.operators import matching as M
from revlens.operators import ordered

from .base import Book, Tables

book = Book()


def _day_sides(spark, sf_dir):
    """Events of even and of odd days as two revisions of a sheet for each (type, pair of days)."""
    events = Tables(spark, sf_dir).events
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    minute = F.hour("ts") * 60 + F.minute("ts")
    rows = events.select(
        F.concat_ws("/", "event_type", F.floor(day / 2)).alias("pair_id"),
        F.col("event_id").alias("ord"),
        F.lit("text").alias("kind"),
        F.concat(F.lit("u"), F.col("user_id") % 20).alias("key"),
        F.concat(F.lit("U"), F.col("user_id") % 20).alias("text"),
        (minute / 1440.0).alias("x"),
        (F.col("value") / 100.0).alias("y"),
        F.pmod(day, F.lit(2)).alias("side"),
    )
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


@book.add()
def j01_spatial_diff(spark, sf_dir):
    """Flagship: findings between two revisions of each sheet."""
    old, new = _day_sides(spark, sf_dir)
    return M.spatial_diff(old, new).select("pair_id", "old_ord", "new_ord", "status", "old_text", "new_text")


@book.add("""
WITH a AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_partkey, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey),
o AS (SELECT l_partkey, round(l_quantity - CASE WHEN abs(l_quantity - low) <= abs(high - l_quantity) THEN low ELSE high END, 6) AS d FROM a JOIN b USING (l_partkey))
SELECT l_partkey, count(*) AS n, list_sort(list(d))[len(list(d)) // 2 + 1] AS offset_ FROM o GROUP BY l_partkey
""")
def j02_offset_upper_median(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem
    ends = lines.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    q = F.col("l_quantity")
    sides = [F.struct(F.abs(q - F.col(c)).alias("distance"), F.lit(k).alias("place"), (q - F.col(c)).alias("dx")) for k, c in enumerate(("low", "high"))]
    pairs = lines.where("l_returnflag = 'R'").select("l_partkey", "l_quantity").join(ends, "l_partkey")
    out = M.nearest_offset(pairs, ["l_partkey"], F.array(*sides), 6)
    return out.withColumnRenamed("offset", "offset_")


@book.add("""
WITH p AS (SELECT md5(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))) AS key, doc_id, source FROM documents),
o AS (SELECT key, count(*) AS n, min(doc_id) AS id FROM p WHERE source < 'src15' GROUP BY key),
w AS (SELECT key, count(*) AS n, min(doc_id) AS id FROM p WHERE source >= 'src15' GROUP BY key),
m AS (SELECT o.key, o.id AS old_id, w.id AS new_id FROM o JOIN w USING (key) WHERE o.n = 1 AND w.n = 1)
SELECT key, old_id, new_id, 'MATCHED' AS status FROM m
UNION ALL SELECT key, doc_id, NULL, 'REMOVED' FROM p WHERE source < 'src15' AND key NOT IN (SELECT key FROM m)
UNION ALL SELECT key, NULL, doc_id, 'ADDED' FROM p WHERE source >= 'src15' AND key NOT IN (SELECT key FROM m)
""")
def j05_exact_reconcile(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    folded = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    rows = docs.select(F.md5(folded).alias("key"), "doc_id", "source")
    return M.unique_pair_reconcile(rows.where("source < 'src15'"), rows.where("source >= 'src15'"), "key", "doc_id")


@book.add()
def j06_mutual_best(spark, sf_dir):
    """Benchmark items and turns of conversations that are each other's best match, by language-free ratio.

    All pairs are scored but those that can't reach ``least - margin`` by their lengths or by the characters they share,
    counted: as a best pair or as a runner-up within the margin they would change nothing.
    """
    t, least, margin = Tables(spark, sf_dir), 0.3, 0.01
    a = t.benchmark.select(F.col("item_id").alias("old_id"), F.col("text").alias("a"))
    b = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("new_id"), F.col("text").alias("b"))
    low = least - margin - 1e-6  # scores are rounded
    total = F.length("a") + F.length("b")
    near = a.join(b, 2 * F.least(F.length("a"), F.length("b")) >= low * total)
    near = near.where(2 * shared_characters(F.col("a"), F.col("b")) >= low * total)
    scored = near.withColumn("score", F.round(ratio(F.col("a"), F.col("b")), 6))
    return M.mutual_best(scored.select("old_id", "new_id", "score"), [], least, margin)


@book.add("""
WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY ALL),
b AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17' GROUP BY ALL)
SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(a.l_linestatus, b.l_linestatus) AS l_linestatus,
  coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new, CASE WHEN a.n IS NULL THEN 'ADDED' WHEN b.n IS NULL THEN 'REMOVED' ELSE 'MATCHED' END AS status
FROM a FULL JOIN b ON a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus
""")
def j07_profile_diff(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem
    old, new = lines.where("l_shipdate < '1995-01-01'"), lines.where("l_shipdate >= '1995-06-17'")
    return M.profile_diff(old, new, ["l_returnflag", "l_linestatus"])


@book.add("""
WITH s AS (SELECT p_brand, p_size <= 20 AS small, min(p_type) AS p_type, min(p_size)::VARCHAR AS p_size FROM part WHERE p_size <= 20 OR p_brand <> 'Brand#11' GROUP BY ALL),
a AS (SELECT * FROM s WHERE small), b AS (SELECT * FROM s WHERE NOT small),
j AS (SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, a.p_brand AS ka, b.p_brand AS kb, a.p_type AS ta, b.p_type AS tb, a.p_size AS sa, b.p_size AS sb FROM a FULL JOIN b ON a.p_brand = b.p_brand),
u AS (SELECT p_brand, ka, kb, 'p_type' AS field, ta AS old, tb AS new FROM j UNION ALL SELECT p_brand, ka, kb, 'p_size', sa, sb FROM j)
SELECT p_brand, field, old, new, CASE WHEN ka IS NULL THEN 'ADDED' WHEN kb IS NULL THEN 'REMOVED' WHEN old IS NOT DISTINCT FROM new THEN 'MATCHED' ELSE 'CHANGED' END AS status FROM u
""")
def j08_keyed_diff(spark, sf_dir):
    part = Tables(spark, sf_dir).part.where("p_size <= 20 or p_brand <> 'Brand#11'")

    def side(rows):
        return rows.groupBy("p_brand").agg(F.min("p_type").alias("p_type"), F.min("p_size").alias("p_size"))

    return M.keyed_diff(side(part.where("p_size <= 20")), side(part.where("p_size > 20")), "p_brand", ["p_type", "p_size"])


@book.add("""
WITH p AS (SELECT user_id, event_id, epoch(ts) AS t FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id, epoch(ts) AS t FROM events WHERE event_type = 'click')
SELECT p.event_id AS left_id, c.event_id AS right_id FROM p JOIN c ON p.user_id = c.user_id AND abs(p.t - c.t) <= 7200
""")
def j12_range_join(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    rows = events.select(
        "user_id", "event_id", "event_type",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
    )
    pairs = M.band_join(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), "user_id", "t", 7200.0)
    return pairs.select(F.col("l.event_id").alias("left_id"), F.col("r.event_id").alias("right_id"))


@book.add("""
SELECT c_custkey AS id, 'no orders' AS issue FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT DISTINCT o_custkey, 'no customer' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def j13_both_anti(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return M.unmatched_both_ways(
        t.customer.select(F.col("c_custkey").alias("id")),
        t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")),
        "id", "no orders", "no customer",
    )


@book.add("""
WITH x AS (SELECT event_id, event_type, minute(ts) / 1.0 AS x, value AS y FROM events WHERE hour(ts) < 12),
z AS (SELECT event_id, event_type, minute(ts) / 1.0 AS x, value AS y FROM events WHERE hour(ts) >= 12)
SELECT x.event_id AS left_id, z.event_id AS right_id, round(sqrt(pow(x.x - z.x, 2) + pow(x.y - z.y, 2)), 6) AS distance
FROM x JOIN z ON x.event_type = z.event_type AND sqrt(pow(x.x - z.x, 2) + pow(x.y - z.y, 2)) <= 0.5
""")
def j19_grid_join(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    points = events.select("event_id", "event_type", F.minute("ts").cast("double").alias("x"), F.col("value").alias("y"), F.hour("ts").alias("h"))
    pairs = M.grid_join(points.where("h < 12"), points.where("h >= 12"), 0.5, ["event_type"])
    return pairs.select(F.col("l.event_id").alias("left_id"), F.col("r.event_id").alias("right_id"), F.round("distance", 6).alias("distance"))


@book.add("""
WITH s AS (SELECT event_id AS entity_id, CASE WHEN event_id % 5 = 0 THEN 'h' || (event_id // 10) END AS handle, 'u' || user_id AS parent, event_type AS type, 'l' || (user_id % 3) AS layer,
  CASE WHEN event_id % 3 = 0 THEN 'v' || floor(value)::INT END AS text, minute(ts)::DOUBLE AS x, value AS y FROM events),
a AS (SELECT entity_id AS address_id, CASE WHEN entity_id % 10 = 0 THEN handle END AS handle, parent, type, layer, text, x + 0.001 AS x, y FROM s WHERE entity_id % 2 = 0),
h AS (SELECT address_id, min(entity_id) AS entity_id FROM a JOIN s USING (handle) GROUP BY address_id HAVING count(*) = 1),
o AS (SELECT * FROM a WHERE handle IS NULL),
p AS (SELECT address_id, min(entity_id) AS entity_id FROM o JOIN s ON o.parent = s.parent AND o.text = s.text GROUP BY address_id HAVING count(*) = 1),
o2 AS (SELECT * FROM o WHERE address_id NOT IN (SELECT address_id FROM p)),
t AS (SELECT address_id, min(entity_id) AS entity_id FROM o2 JOIN s ON o2.type = s.type AND o2.layer = s.layer AND o2.text = s.text GROUP BY address_id HAVING count(*) = 1),
o3 AS (SELECT * FROM o2 WHERE address_id NOT IN (SELECT address_id FROM t)),
d AS (SELECT address_id, entity_id, sqrt(pow(o3.x - s.x, 2) + pow(o3.y - s.y, 2)) AS d FROM o3 JOIN s ON o3.type = s.type AND sqrt(pow(o3.x - s.x, 2) + pow(o3.y - s.y, 2)) <= 1.0),
n AS (SELECT address_id, min(entity_id) AS entity_id FROM (SELECT *, min(d) OVER (PARTITION BY address_id) AS best FROM d) WHERE d <= best + 1e-9 GROUP BY address_id HAVING count(*) = 1)
SELECT address_id, coalesce(h.entity_id, p.entity_id, t.entity_id, n.entity_id) AS entity_id,
  CASE WHEN h.entity_id IS NOT NULL THEN 'handle' WHEN p.entity_id IS NOT NULL THEN 'parent' WHEN t.entity_id IS NOT NULL THEN 'text' WHEN n.entity_id IS NOT NULL THEN 'nearest' ELSE 'unresolved' END AS tier
FROM a LEFT JOIN h USING (address_id) LEFT JOIN p USING (address_id) LEFT JOIN t USING (address_id) LEFT JOIN n USING (address_id)
""")
def j20_tiered_resolve(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    i = F.col("event_id")
    s = events.select(
        i.alias("entity_id"),
        F.when(i % 5 == 0, F.concat(F.lit("h"), F.floor(i / 10).cast("string"))).alias("handle"),
        F.concat(F.lit("u"), "user_id").alias("parent"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("l"), F.col("user_id") % 3).alias("layer"),
        F.when(i % 3 == 0, F.concat(F.lit("v"), F.floor("value").cast("string"))).otherwise("").alias("text"),
        F.minute("ts").cast("double").alias("x"),
        F.col("value").alias("y"),
    )
    a = s.where("entity_id % 2 = 0").withColumns(
        {"handle": F.when(F.col("entity_id") % 10 == 0, F.col("handle")), "x": F.col("x") + 0.001}
    )
    return M.tiered_resolve(a.withColumnRenamed("entity_id", "address_id"), s)


@book.add("""
WITH p AS (SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS distance FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 200),
b AS (SELECT *, min(distance) OVER (PARTITION BY s_suppkey) AS best FROM p),
g AS (SELECT s_suppkey, count(*) AS n, min(c_custkey) AS c, min(distance) AS distance FROM b WHERE distance <= best + 1e-9 GROUP BY s_suppkey)
SELECT s.s_suppkey, CASE WHEN n = 1 THEN c END AS c_custkey, round(distance, 6) AS distance, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'resolved' ELSE 'tie' END AS outcome
FROM supplier s LEFT JOIN g USING (s_suppkey)
""")
def j21_nearest_no_ties(spark, sf_dir):
    t = Tables(spark, sf_dir)
    left = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"))
    right = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))
    out = M.nearest_or_none(left, right, "nation", "v", "s_suppkey", "c_custkey", 200.0)
    return out.withColumn("distance", F.round("distance", 6))


@book.add("""
WITH e AS (SELECT l_orderkey % 500 AS exp, l_orderkey, l_linenumber, l_returnflag <> 'N' AS cat_off, l_linestatus <> 'F' AS stat_off, abs(l_quantity - 25) AS d FROM lineitem)
SELECT exp, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY exp ORDER BY cat_off, stat_off, d, l_orderkey, l_linenumber) AS n FROM e) WHERE n = 1
""")
def j24_best_candidate(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem
    rows = lines.select(
        (F.col("l_orderkey") % 500).alias("exp"),
        F.struct((F.col("l_returnflag") != "N").alias("a"), (F.col("l_linestatus") != "F").alias("b"), F.abs(F.col("l_quantity") - 25).alias("d"), "l_orderkey", "l_linenumber").alias("rank"),
    )
    return rows.groupBy("exp").agg(F.min("rank").alias("r")).select("exp", "r.l_orderkey", "r.l_linenumber")


@book.add("""
WITH a AS (SELECT DISTINCT least(o_custkey, o_orderkey % 1000) || '-' || greatest(o_custkey, o_orderkey % 1000) AS key FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT least(o_custkey, o_orderkey % 1000) || '-' || greatest(o_custkey, o_orderkey % 1000) AS key FROM orders WHERE o_orderstatus = 'O')
SELECT key, 'added' AS status FROM b WHERE key NOT IN (SELECT key FROM a) UNION ALL SELECT key, 'deleted' FROM a WHERE key NOT IN (SELECT key FROM b)
UNION ALL SELECT key, 'unchanged' FROM a JOIN b USING (key)
""")
def j25_set_diff(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    ends = F.array_sort(F.array("o_custkey", F.col("o_orderkey") % 1000))
    keyed = orders.select("o_orderstatus", F.concat_ws("-", ends[0], ends[1]).alias("key"))
    return M.hash_set_diff(keyed.where("o_orderstatus = 'F'"), keyed.where("o_orderstatus = 'O'"), "key")


@book.add("""
WITH e AS (SELECT event_type, floor(value)::BIGINT AS v, event_id, day(ts) <= 15 AS early FROM events),
a AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type, v ORDER BY event_id) AS occurrence, event_id AS old_id FROM e WHERE early),
b AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type, v ORDER BY event_id) AS occurrence, event_id AS new_id FROM e WHERE NOT early)
SELECT event_type, v, occurrence, old_id, new_id, CASE WHEN old_id IS NULL THEN 'ADDED' WHEN new_id IS NULL THEN 'REMOVED' ELSE 'MATCHED' END AS status
FROM a FULL JOIN b USING (event_type, v, occurrence)
""")
def j26_multiset_diff(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    rows = events.select("event_type", F.floor("value").alias("v"), "event_id", (F.dayofmonth("ts") <= 15).alias("early"))
    return M.multiset_diff(rows.where("early"), rows.where("not early"), ["event_type", "v"], "event_id")


@book.add("""
WITH top AS (SELECT o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
SELECT o_orderkey, o_orderdate, coalesce(c_name, 'Unknown Drawing') AS name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items
FROM top LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey
""")
def j27_trend(spark, sf_dir):
    t = Tables(spark, sf_dir)
    names = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    sessions = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", "o_custkey")
    items = t.lineitem.select("l_orderkey")
    return M.trend(sessions, names, items, "o_orderkey", "o_custkey", "l_orderkey", "o_orderdate", 20, "Unknown Drawing")


@book.add("""
WITH prior AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, max_by(event_id, event_id) AS v FROM events WHERE day(ts) < 20 GROUP BY ALL),
days AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS n FROM (SELECT DISTINCT user_id, day FROM prior)),
r AS (SELECT p.user_id, event_type, max_by(v, p.day) AS carried FROM prior p JOIN days d ON p.user_id = d.user_id AND p.day = d.day AND n <= 5 GROUP BY ALL)
SELECT event_id, carried FROM (SELECT * FROM events WHERE day(ts) >= 20) e LEFT JOIN r ON e.user_id = r.user_id AND e.event_type = r.event_type
""")
def j29_carry_forward(spark, sf_dir):
    events = Tables(spark, sf_dir).events.withColumn("day", F.date_trunc("day", F.col("ts").cast("timestamp")))
    prior = events.where(F.dayofmonth("ts") < 20).groupBy("user_id", "day", "event_type").agg(F.max("event_id").alias("v"))
    current = events.where(F.dayofmonth("ts") >= 20).select("user_id", "event_type", "event_id")
    return M.carry_forward(current, prior, "user_id", "day", "event_type", "v").select("event_id", "carried")


@book.add("""
SELECT a.user_id, len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) = 0 AS mismatch FROM
 (SELECT user_id, list(DISTINCT upper(event_type)) AS t FROM events WHERE day(ts) <= 3 GROUP BY user_id) a JOIN
 (SELECT user_id, list(DISTINCT upper(event_type)) AS t FROM events WHERE day(ts) >= 27 GROUP BY user_id) b USING (user_id)
""")
def j31_pair_mismatch(spark, sf_dir):
    events = Tables(spark, sf_dir).events

    def side(rows, name):
        return rows.groupBy("user_id").agg(F.collect_set("event_type").alias(name))

    both = side(events.where(F.dayofmonth("ts") <= 3), "a").join(side(events.where(F.dayofmonth("ts") >= 27), "b"), "user_id")
    return both.select("user_id", M.disjoint_tokens(F.col("a"), F.col("b")).alias("mismatch"))


@book.add("""
WITH v AS (SELECT p_partkey, p_size, p_retailprice, unnest([0, 1, 2]) AS k FROM part), d AS (
  SELECT *, sqrt(pow(p_size - ([10.0, 25.0, 40.0])[k + 1], 2) + pow((p_retailprice - ([1000.0, 1300.0, 1700.0])[k + 1]) / 20, 2)) AS d FROM v
), n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, k) AS r FROM d WHERE d <= 15)
SELECT k, count(*) AS n, min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM n WHERE r = 1 GROUP BY k
""")
def j32_nearest_anchor(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    anchors = [(10.0, 1000.0), (25.0, 1300.0), (40.0, 1700.0)]
    place = F.array(
        *[F.struct(F.hypot(F.col("p_size") - x, (F.col("p_retailprice") - y) / 20).alias("d"), F.lit(k).alias("k")) for k, (x, y) in enumerate(anchors)]
    )
    near = part.withColumn("best", F.array_min(place)).where("best.d <= 15")
    return near.groupBy(F.col("best.k").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.min("p_size").alias("x0"), F.max("p_size").alias("x1"), F.min("p_retailprice").alias("y0"), F.max("p_retailprice").alias("y1")
    )


@book.add("""
WITH r AS (SELECT DISTINCT l_partkey AS id, 'lineitem' AS s FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_size = 1
  UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders WHERE o_orderstatus = 'P')
SELECT id, string_agg(s, ',' ORDER BY s) AS referrers FROM r WHERE id IS NOT NULL GROUP BY id
""")
def j33_referrers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return M.referrers(
        {
            "lineitem": t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("id")),
            "part": t.part.where("p_size = 1").select(F.col("p_partkey").alias("id")),
            "orders": t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")),
        }
    )


@book.add("""
SELECT o_custkey AS src, o_orderkey AS dst, p_name AS label FROM orders LEFT JOIN part ON p_partkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
""")
def j34_neighbours(spark, sf_dir):
    t = Tables(spark, sf_dir)
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    edges = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return M.neighbours(nodes, edges, t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("id")))


@book.add("""
WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier), b AS (
  SELECT s_nationkey, s_suppkey, s_acctbal AS score, row_number() OVER w AS n, lead(s_acctbal) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey))
SELECT s_nationkey, s_suppkey, score, round(score - nxt, 6) AS margin FROM b WHERE n = 1
""")
def w04_runner_up(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier.select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("score"))
    return ordered.runner_up(s, ["s_nationkey"], "score", "s_suppkey").withColumn("margin", F.round("margin", 6))


@book.add("""
SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 3
""")
def w06_stack_places(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return c.select("c_custkey", "c_nationkey", F.row_number().over(w).alias("place")).where("place <= 3")
