"""Filters, projections, zones and scalars on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens.functions import geometry as G
from revlens.functions import text as X
from revlens.operators import filters

from .base import Book, Tables

book = Book()
HEXAGON = [(5.0, 950.0), (20.0, 900.0), (40.0, 1000.0), (45.0, 1500.0), (25.0, 1800.0), (8.0, 1400.0)]
HEXAGON_SQL = "[(5.0, 950.0), (20.0, 900.0), (40.0, 1000.0), (45.0, 1500.0), (25.0, 1800.0), (8.0, 1400.0)]"


@book.add("""
SELECT p_partkey, p_name, p_brand FROM part
WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND contains(lower(p_name), 'a') AND regexp_matches(p_type, '^[A-Z]')
""")
def f01_entity_query(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    found = filters.entity_query(part, "p_brand", "p_name", types=["Brand#11", "Brand#22", "Brand#33"], contains="A")
    found = filters.entity_query(found, "p_brand", "p_type", pattern="^[A-Z]", text_only=True)
    return filters.entity_query(found, "p_brand", "p_type", pattern="([").select("p_partkey", "p_name", "p_brand")


@book.add("""
SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id
""")
def f02_lookup_last_wins(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    return filters.last_by_key(events, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@book.add(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat FROM documents WHERE trim(coalesce(text, '')) <> '')
SELECT doc_id, CASE WHEN length(flat) > 80 THEN substr(flat, 1, 77) || '...' ELSE flat END AS preview,
       greatest((SELECT count(*) FROM d) - 50, 0) AS omitted
FROM d ORDER BY doc_id LIMIT 50
""")
def f03_manifest(spark, sf_dir):
    return filters.manifest(Tables(spark, sf_dir).documents, "doc_id", "text", 50)


@book.add("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 950.0 AND 1400.0")
def f04_in_box(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return part.where(G.in_box(F.col("p_size"), F.col("p_retailprice"), (10, 950.0, 20, 1400.0))).select("p_partkey")


POLYGON_SQL = """
WITH e AS (SELECT unnest(range(6)) AS i), s AS (
  SELECT ([5.0, 20.0, 40.0, 45.0, 25.0, 8.0])[i + 1]::DOUBLE AS ax, ([950.0, 900.0, 1000.0, 1500.0, 1800.0, 1400.0])[i + 1]::DOUBLE AS ay,
         ([8.0, 5.0, 20.0, 40.0, 45.0, 25.0])[i + 1]::DOUBLE AS bx, ([1400.0, 950.0, 900.0, 1000.0, 1500.0, 1800.0])[i + 1]::DOUBLE AS by_ FROM e
), hit AS (
  SELECT p_partkey, count(*) FILTER (WHERE (ay > p_retailprice) <> (by_ > p_retailprice)
    AND p_size < (bx - ax) * (p_retailprice - ay) / (by_ - ay) + ax) AS n FROM part, s GROUP BY p_partkey
)
SELECT p_partkey FROM hit WHERE n % 2 = 1
"""


@book.add(POLYGON_SQL)
def f05_point_in_polygon(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return part.where(G.in_polygon(F.col("p_size").cast("double"), F.col("p_retailprice"), HEXAGON)).select("p_partkey")


@book.add(POLYGON_SQL)
def f06_point_in_shape(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    outline = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in HEXAGON])
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return part.where(G.in_box(x, y, (5, 900.0, 45, 1800.0)) & G.in_polygon_column(x, y, outline)).select("p_partkey")


@book.add("""
SELECT p_partkey FROM part WHERE (p_size BETWEEN 5 AND 40 AND p_retailprice BETWEEN 900 AND 1600)
  AND NOT (p_size BETWEEN 5 AND 12 AND p_retailprice BETWEEN 900 AND 1000)
  AND NOT (p_size BETWEEN 30 AND 40 AND p_retailprice BETWEEN 1400 AND 1600)
""")
def f09_scope_to_view(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    x, y = F.col("p_size"), F.col("p_retailprice")
    siblings = [((5, 900, 12, 1000), None), ((30, 1400, 40, 1600), None)]
    return part.where(G.in_shape(x, y, (5, 900, 40, 1600)) & ~G.in_any_shape(x, y, siblings)).select("p_partkey")


@book.add("""
SELECT p_partkey, p_brand FROM part
WHERE p_size BETWEEN 5 AND 45 AND NOT (p_size < 7 OR p_size > 43) AND NOT (p_size BETWEEN 20 AND 25)
  AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice > 1900)
  AND p_brand NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 90)
""")
def f15_zone_pool(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    size = F.col("p_size")
    values = part.where("p_retailprice > 1900").select("p_brand").distinct()
    rules = part.groupBy("p_brand").count().where("count >= 90").select("p_brand")
    kept = filters.pool(part, size.between(5, 45), (size < 7) | (size > 43), size.between(20, 25), "p_brand", values, rules)
    return kept.select("p_partkey", "p_brand")


@book.add("SELECT p_partkey FROM part WHERE p_size <= 3")
def f17_filter_with_fallback(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return filters.with_fallback(part, F.col("p_size") > 1000, F.col("p_size") <= 3).select("p_partkey")


@book.add("""
SELECT DISTINCT value FROM (SELECT trim(p_brand) AS value FROM part UNION ALL SELECT trim(p_type) FROM part) WHERE length(value) >= 3
""")
def f20_structured_values(spark, sf_dir):
    return filters.structured_values(Tables(spark, sf_dir).part, ["p_brand", "p_type"])


@book.add("""
WITH o AS (
  SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 20 AND p_retailprice BETWEEN 900 AND 1200 THEN 'title'
    WHEN p_size BETWEEN 10 AND 35 AND p_retailprice BETWEEN 1000 AND 1500 THEN 'notes'
    WHEN p_size BETWEEN 1 AND 50 AND p_retailprice BETWEEN 900 AND 1800 THEN 'views' END AS owner FROM part
)
SELECT p_partkey, owner, coalesce(owner = 'title', false) AS outranked FROM o
""")
def f21_zone_owner(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    x, y = F.col("p_size"), F.col("p_retailprice")
    ranks = {"title": 1, "notes": 2, "views": 3}
    zones = [
        ("views", 3, G.in_box(x, y, (1, 900, 50, 1800))),
        ("title", 1, G.in_box(x, y, (1, 900, 20, 1200))),
        ("notes", 2, G.in_box(x, y, (10, 1000, 35, 1500))),
    ]
    owned = part.select("p_partkey", filters.owner(x, y, zones).alias("owner"))
    return owned.withColumn("outranked", filters.owned_by_other(F.col("owner"), ranks, "notes"))


@book.add("""
SELECT o_orderkey, o_custkey FROM orders WHERE coalesce(o_orderstatus = 'P', false) = false
  AND (nullif(o_custkey % 7, 0) = 3 OR nullif(o_custkey % 7, 0) IS NULL)
""")
def f24_mine_and_live(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders.withColumn("owner", F.nullif(F.col("o_custkey") % 7, F.lit(0)))
    rows = filters.mine(filters.live(orders, F.col("o_orderstatus") == "P"), "owner", 3)
    return rows.select("o_orderkey", "o_custkey")


@book.add("""
SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3')
  AND (contains(lower(text), 'license') OR contains(lower(text), 'worthless') OR contains(lower(text), 'a.b(c'))
""")
def f29_keyword_search(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    scope = F.col("source").isin("src1", "src2", "src3")
    return filters.keyword_search(docs, "text", ["license", "worthless", "a.b(c"], scope).select("doc_id")


@book.add("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type),
  '[^a-z0-9]+'), lambda w: length(w) >= 3))), ',') AS words FROM part
""")
def f30_keywords(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    words = filters.keywords(F.concat_ws(" ", "p_name", "p_type"), 3)
    return part.select("p_partkey", F.array_join(F.array_sort(words), ",").alias("words"))


@book.add(r"""
WITH k AS (
  SELECT event_id, lower(event_type || ' ' || (user_id % 5)) AS key FROM events
)
SELECT event_id, (key = 'click 1' OR starts_with(key, 'purch')) AS dismissed FROM k
""")
def f32_dismissed(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    texts = events.select("event_id", F.concat(F.upper("event_type"), F.lit("  "), F.col("user_id") % 5).alias("text"))
    rules = spark.createDataFrame([("click 1", False), ("purch", True), ("pu", True)], "key string, prefix boolean")
    return filters.dismissed(texts, "text", rules).select("event_id", "dismissed")


@book.add("""
SELECT o_orderkey FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
WHERE (contains(lower(c_name), '7') OR contains(lower(n_name), 'an') OR contains(lower(o_orderpriority), '7'))
  AND o_orderstatus = 'F' AND o_totalprice >= 85000
""")
def f38_session_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    rows = t.orders.where("o_orderstatus = 'F' and o_totalprice >= 85000").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    hit = F.lower("c_name").contains("7") | F.lower("n_name").contains("an") | F.lower("o_orderpriority").contains("7")
    return rows.where(hit).select("o_orderkey")


def _neighbours(spark, sf_dir):
    """``conv_id, turn, a, b``: the text of every turn and of the one after it, if there is one."""
    turns = Tables(spark, sf_dir).conversations
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return turns.select("conv_id", "turn", F.col("text").alias("a")).join(after, ["conv_id", "turn"], "left")


@book.add(r"""
WITH t AS (
  SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
), v AS (SELECT conv_id, turn, 'x' AS kind, a, b FROM t
  UNION ALL SELECT conv_id, turn, 'same', replace(a, 'ß', 's'), upper(replace(a, 'ß', 's')) FROM t UNION ALL SELECT conv_id, turn, 'swap', '1:2', '1/2' FROM t
  UNION ALL SELECT conv_id, turn, 'none', 'NONE', b FROM t UNION ALL SELECT conv_id, turn, 'gone', a, ' ' FROM t
), n AS (SELECT *, trim(coalesce(nullif(a, ''), 'NONE')) AS o, trim(coalesce(nullif(b, ''), 'NONE')) AS k FROM v), f AS (
  SELECT *, CASE WHEN o = 'NONE' THEN '' ELSE regexp_replace(replace(regexp_replace(lower(o), '[x×ラｘ]', 'x', 'g'), ':', '/'), '[ \t\n]+', '', 'g') END AS fo,
    CASE WHEN k = 'NONE' THEN '' ELSE regexp_replace(replace(regexp_replace(lower(k), '[x×ラｘ]', 'x', 'g'), ':', '/'), '[ \t\n]+', '', 'g') END AS fk FROM n
)
SELECT conv_id, turn, kind, CASE WHEN o = k THEN 'MATCHED' WHEN (contains(o, ':') AND contains(k, '/')) OR (contains(o, '/') AND contains(k, ':')) THEN 'CHANGED'
  WHEN fo = fk THEN 'MATCHED' WHEN fo = '' THEN 'ADDED' WHEN fk = '' THEN 'REMOVED' ELSE 'CHANGED' END AS status FROM f
""")
def x06_compare_values(spark, sf_dir):
    sides = _neighbours(spark, sf_dir)
    cases = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), a.alias("o"), b.alias("n"))
            for kind, a, b in (
                ("x", F.col("a"), F.col("b")), ("same", F.replace("a", F.lit("ß"), F.lit("s")), F.upper(F.replace("a", F.lit("ß"), F.lit("s")))), ("swap", F.lit("1:2"), F.lit("1/2")),
                ("none", F.lit("NONE"), F.col("b")), ("gone", F.col("a"), F.lit(" ")),
            )
        ]
    )
    rows = sides.select("conv_id", "turn", F.inline(cases))
    return rows.select("conv_id", "turn", "kind", X.compare_values(F.col("o"), F.col("n")).alias("status"))


@book.add(r"""
SELECT l_orderkey, l_linenumber, starts_with(l_orderkey::VARCHAR, l_linenumber::VARCHAR) AS prefix,
  ends_with(l_orderkey::VARCHAR, l_linenumber::VARCHAR) AS suffix, contains(l_orderkey::VARCHAR, l_linenumber::VARCHAR) AS infix FROM lineitem
""")
def x07_component_of(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem
    value, number = F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")
    return lines.select(
        "l_orderkey", "l_linenumber", *[X.component_of(value, number, p).alias(p) for p in ("prefix", "suffix", "infix")]
    )


@book.add("""
SELECT p_partkey, round((p_size - 1) / 49.0::DOUBLE, 6) AS ux, round((p_retailprice - 900) / 1200.0::DOUBLE, 6) AS uy,
  printf('aspect-%.3f', p_size / 50.0::DOUBLE) AS signature FROM part
""")
def x13_unit_square(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    return part.select(
        "p_partkey",
        F.round(G.unit(F.col("p_size").cast("double"), 1.0, 50.0), 6).alias("ux"),
        F.round(G.unit(F.col("p_retailprice"), 900.0, 2100.0), 6).alias("uy"),
        G.sheet_signature(F.col("p_size").cast("double"), F.lit(50.0)).alias("signature"),
    )


@book.add(r"""
WITH w AS (SELECT item_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n]+'), lambda w: w <> '')) || ' ' AS word FROM benchmark),
g AS (SELECT item_id, n, word, unnest(range(1, length(word) - n + 2)) AS i FROM w, (SELECT unnest([2, 3, 4]) AS n) WHERE length(word) >= n)
SELECT item_id, substr(word, i, n) AS gram, count(*) AS n FROM g GROUP BY ALL
""")
def x14_char_ngrams(spark, sf_dir):
    items = Tables(spark, sf_dir).benchmark
    grams = items.select("item_id", F.explode(X.char_ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("n"))


@book.add("""
SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value >= 100 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS band FROM events
""")
def x34_confidence_band(spark, sf_dir):
    events = Tables(spark, sf_dir).events
    band = X.banded(F.col("value"), [(100.0, "high"), (25.0, "medium")], "low")
    return events.select("event_id", F.when(F.col("value").isNull(), "unknown").otherwise(band).alias("band"))


@book.add(r"""
SELECT page_id, regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g') AS name,
  CASE WHEN regexp_matches(url, '^https') THEN 'secure' WHEN regexp_matches(url, 'page=') THEN 'paged' ELSE 'other' END AS kind FROM pages
""")
def x35_names_and_rules(spark, sf_dir):
    pages = Tables(spark, sf_dir).pages
    kind = X.first_rule(F.col("url"), [("^https", "secure"), ("page=", "paged")], "other")
    return pages.select("page_id", X.safe_name(F.col("url")).alias("name"), kind.alias("kind"))


@book.add(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+', '[REDACTED]', 'g'), '[0-9]{6,}', '[REDACTED]', 'g')) AS digest FROM documents
""")
def x36_redaction(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    clean = X.redact(F.col("text"), [r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", r"[0-9]{6,}"])
    return docs.select("doc_id", F.md5(clean).alias("digest"))


@book.add("""
WITH k AS (SELECT conv_id, turn, coalesce(lower(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))), '') AS key FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN a.key = '' THEN coalesce(b.key, '') || '->' ELSE a.key || '->' || coalesce(b.key, '') END AS key
FROM k a LEFT JOIN k b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
""")
def x16_pair_key(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("conv_id", "turn", X.pair_key(F.col("a"), F.col("b")).alias("key"))


@book.add("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, (p_retailprice - 900) / 20 AS y FROM part)
SELECT p_partkey, round(sqrt(pow(x - (5 + 40 * t), 2) + pow(y - (10 + 30 * t), 2)), 6) AS distance FROM (
  SELECT *, least(greatest(((x - 5) * 40 + (y - 10) * 30) / 2500.0, 0), 1) AS t FROM p)
""")
def x32_segment_distance(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    x, y = F.col("p_size").cast("double"), (F.col("p_retailprice") - 900) / 20
    ends = [F.lit(v) for v in (5.0, 10.0, 45.0, 40.0)]
    return part.select("p_partkey", F.round(G.segment_distance(x, y, *ends), 6).alias("distance"))


@book.add("""
SELECT p_partkey, round(0 + least(greatest(p_size / 25.0::DOUBLE - 1, -0.5), 1.5) * 420, 6) AS x,
  round(297 - least(greatest(p_size / 40.0::DOUBLE, -0.5), 1.5) * 297, 6) AS y FROM part
""")
def x25_fractions_to_sheet(spark, sf_dir):
    part = Tables(spark, sf_dir).part
    size = F.col("p_size").cast("double")
    x, y = G.from_fractions(size / 25.0 - 1, size / 40.0, (0.0, 0.0, 420.0, 297.0))
    return part.select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@book.add()
def x10_ratio(spark, sf_dir):
    """Similarity of each turn and the next one of its conversation."""
    return _neighbours(spark, sf_dir).select("conv_id", "turn", F.round(X.ratio(F.col("a"), F.col("b")), 6).alias("ratio"), X.normal_key(F.col("a")).alias("key"))
