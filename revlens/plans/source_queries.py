"""Readers and writers on the supplied tables: JSON lines, slices by key, corpora by manifest, chunks of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revlens.operators.folds import shared_root
from revlens.sources import files

from .base import Book, Tables

book = Book()


def _folder(spark) -> str:
    return f"{shared_root(spark)}/files-{uuid.uuid4().hex}"


@book.add("SELECT event_id, user_id, event_type, value, NULL::INT AS missing FROM events")
def s19_typed_lines(spark, sf_dir):
    """Events written as JSON lines and read back by a schema: fields that it lacks are left out, those that the file lacks are null."""
    folder = _folder(spark)
    files.write_json_lines(Tables(spark, sf_dir).events.select("event_id", "user_id", "event_type", "value", "props"), folder)
    return files.read_json_lines(spark, folder, "event_id long, user_id long, event_type string, value double, missing int")


@book.add("""
SELECT '{"kind":' || CASE WHEN p_size % 7 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || ',"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"size":' || p_size || '}' AS line FROM part
""")
def s20_canonical_lines(spark, sf_dir):
    """Every part as one line of JSON, fields in order of name, nulls kept."""
    part = Tables(spark, sf_dir).part
    rows = part.select(F.col("p_size").alias("size"), "p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("kind"), "p_name")
    return rows.select(files.canonical_json(rows).alias("line"))


@book.add("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_orderstatus, 0 FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000")
def s22_replaced_slice(spark, sf_dir):
    """Orders stored in slices by status; the slice P is written anew, the others stay."""
    folder = _folder(spark)
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    files.write_slices(orders, folder, "o_orderstatus")
    files.write_slices(orders.where("o_orderstatus = 'P' and o_totalprice > 1000").withColumn("o_totalprice", F.lit(0.0)), folder, "o_orderstatus")
    return spark.read.parquet(folder).select("o_orderkey", "o_orderstatus", "o_totalprice")


@book.add("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def s18_entities_of_one_slice(spark, sf_dir):
    """Lines stored in slices by return flag, and those of one slice; the other slices' files aren't opened."""
    folder = _folder(spark)
    files.write_slices(Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), folder, "l_returnflag")
    return files.entities(spark, folder, "l_returnflag", "R").select("l_orderkey", "l_linenumber", "l_partkey")


@book.add("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE NOT coalesce(CASE WHEN c_nationkey > 20 THEN NULL ELSE c_acctbal < 0 END, false) AND c_mktsegment = 'BUILDING')
""")
def s21_corpus_by_manifest(spark, sf_dir):
    """Orders of the customers that a manifest names: none held out, of one origin."""
    t = Tables(spark, sf_dir)
    manifest = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") <= 20, F.col("c_acctbal") < 0).alias("held"), "c_mktsegment")
    return files.corpus(manifest, t.orders, "o_custkey", "held", origin=F.col("c_mktsegment") == "BUILDING").select("o_orderkey", "o_custkey")


@book.add(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS body FROM documents),
s AS (SELECT *, sum(CASE WHEN regexp_matches(body, '^#+ *[^\s]|^\d+\.\d+ [A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS s FROM l),
c AS (SELECT *, floor(coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id, s ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000) AS c FROM s)
SELECT doc_id, c::INT AS chunk, min(line)::INT AS first_line, max(line)::INT AS last_line, md5(string_agg(body, chr(10) ORDER BY line)) AS digest FROM c GROUP BY doc_id, s, c.c HAVING length(trim(string_agg(body, chr(10) ORDER BY line))) > 0
""")
def s15_text_sections(spark, sf_dir):
    """Every document in chunks of lines of about 1,000 characters, cut at its sections."""
    chunks = files.section_chunks(Tables(spark, sf_dir).documents, "doc_id", "text")
    return chunks.select("doc_id", "chunk", "first_line", "last_line", F.md5("body").alias("digest"))


@book.add()
def s16_heading_chunks(spark, sf_dir):
    """Every document as Markdown, its first line a heading: headings with what follows them."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", F.concat(F.lit("# "), "text").alias("text"))
    return files.heading_chunks(docs, "doc_id", "text").select("doc_id", "no", "heading", F.md5("body").alias("digest"))
