"""Queries over the given tables, one for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embed, htmltext, langid, linededup, mixing, phrases, quality, simhash, tokens, urls, whiten
from .common import held_out

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URL_WORDS = ("ads", "adult", "bet", "casino", "gambling", "pills", "porn", "spam", "viagra", "warez")  # in names of hosts that are listed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = held_out(F.col("doc_id"), 4, 2)
    dictionaries = langid.fit_dictionaries(docs.where(~fold))
    seen = langid.identify(docs.select("doc_id", "text", fold.alias("held_out")), dictionaries)
    return seen.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embedding_groups(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.with_token_counts(docs, vocabulary).select("doc_id", "n_tokens")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = linededup.with_kept_text(docs)
    return seen.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"),
        F.lit(hard).alias("text"),
    )
    made = chat.windows(rows.unionByName(extra.withColumn("turn", F.col("turn").cast("long"))))
    turns = chat.read_turns(F.col("formatted"), F.col("repeated"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = made.select(
        "conv_id",
        "window",
        F.size(turns).alias("n"),
        F.array_join(lines, "").alias("said"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"),
        F.length(F.array_join("parts.loss", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("parts.loss", ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = decontam.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return held.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"))
    mixed = mixing.mix(sized, size_col="words")
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = held_out(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~fold))
    scored = quality.with_quality(docs.withColumn("held_out", fold), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.with_main_text(pages).select("page_id", "url", "text", "n_chars")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = whiten.with_whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=32)
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    rows = seen.select("vec_id", "n", "deviation", "identity_error", parts)
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error"
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = urls.hosts_named(pages, URL_WORDS)
    return urls.judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM documents
), w AS (
  SELECT doc_id, no, line, list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM l
), s AS (
  SELECT DISTINCT ON (key) list_sort(words) AS key, doc_id, no, len(words) AS n FROM w WHERE len(words) > 0 ORDER BY key, doc_id, no
), c AS (SELECT row_number() OVER () AS id, * FROM s), t AS (SELECT id, n, doc_id, no, unnest(key) AS word FROM c), f AS (
  SELECT word, count(*) AS df FROM t GROUP BY word
), p AS (
  SELECT * FROM (SELECT id, n, doc_id, no, word, row_number() OVER (PARTITION BY id ORDER BY df, word) AS pos FROM t JOIN f USING (word))
  WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1
), pair AS (
  SELECT DISTINCT a.id AS early, b.id AS late FROM p a JOIN p b USING (word)
  WHERE (a.doc_id, a.no) < (b.doc_id, b.no) AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
), late AS (
  SELECT DISTINCT late AS id FROM pair JOIN c a ON a.id = early JOIN c b ON b.id = late
  WHERE len(list_intersect(a.key, b.key)) >= 0.8 * (a.n + b.n - len(list_intersect(a.key, b.key))) - 1e-9
), kept AS (SELECT doc_id, no FROM c WHERE id NOT IN (SELECT id FROM late))
SELECT w.doc_id, count(*)::INT AS n_lines, count(*) FILTER (WHERE len(words) > 0 AND kept.no IS NULL)::INT AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY w.no) FILTER (WHERE len(words) = 0 OR kept.no IS NOT NULL), '')) AS kept_md5
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id AND w.no = kept.no GROUP BY w.doc_id
"""

OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 4 AS tokens FROM rows
), placed AS (
  SELECT *, row_number() OVER w - 1 AS idx, sum(tokens) OVER w AS stop, (tokens > 512)::INT AS big,
         sum((tokens > 512)::INT) OVER w - (tokens > 512)::INT AS large
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), spans AS (
  SELECT *, stop - tokens AS start, min(idx) OVER v AS win, min(stop - tokens) OVER v AS pos
  FROM placed WINDOW v AS (PARTITION BY conv_id, floor((stop - tokens) / 512.0), 2 * large + big)
), firsts AS (SELECT conv_id, win, pos FROM spans WHERE idx = win), items AS (
  SELECT conv_id, role, text FROM spans
  UNION ALL SELECT f.conv_id, role, text FROM firsts f JOIN spans s ON f.conv_id IS NOT DISTINCT FROM s.conv_id
    WHERE f.win > 0 AND idx = 0 AND role = 'system'
  UNION ALL SELECT f.conv_id, role, text FROM firsts f JOIN spans s ON f.conv_id IS NOT DISTINCT FROM s.conv_id
    WHERE NOT (idx = 0 AND role = 'system') AND f.pos >= stop AND f.pos - start <= 256
), chars AS (
  SELECT conv_id, sum(15 + length(role) + length(text)
    + len(regexp_extract_all(role || text, '[\\<>]')))::BIGINT AS formatted_chars FROM items GROUP BY conv_id
), said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM rows GROUP BY conv_id
)
SELECT said.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM said JOIN chars ON said.conv_id IS NOT DISTINCT FROM chars.conv_id
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN source_size <= 0 THEN -1 ELSE source_size * 3.0::DOUBLE / weight END, source) AS k
  FROM s
), p AS (
  SELECT *, coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM r
), level AS (
  SELECT k AS first_open, ((SELECT sum(source_size) FROM s) - capped) / open_weight AS unit FROM p
  WHERE source_size > 0 AND weight * (((SELECT sum(source_size) FROM s) - capped) / open_weight) <= source_size * 3.0::DOUBLE
  ORDER BY k LIMIT 1
), t AS (
  SELECT p.source, source_size,
         CASE WHEN first_open IS NULL OR k < first_open THEN source_size * 3.0::DOUBLE ELSE weight * unit END AS target,
         ('0x' || substr(md5(coalesce(p.source, '-') || '|42|offset'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS first
  FROM p LEFT JOIN level ON true
), o AS (
  SELECT doc_id, size, source_size, target, first,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(size)),
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || '|42'), 1, 8))::BIGINT % 64, doc_id, size) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(first + place * rate) - floor(first + (place - 1) * rate)) * size)::BIGINT AS taken
FROM o
"""


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces), grams AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS v(k))
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL), c AS (SELECT * FROM f WHERE k > 1 AND f >= 10), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, cut, array_to_string(string_split(c.phrase, ' ')[: cut], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[cut + 1 :], ' ') AS rest
  FROM c, (VALUES (1), (2)) AS v(cut) WHERE cut < c.k
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, p.f AS l, q.f AS r, ((1000000::HUGEINT * a * a) // (p.f::HUGEINT * q.f))::BIGINT AS score,
         row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (1000000::HUGEINT * a * a) // (p.f::HUGEINT * q.f), cut) AS no
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = first JOIN f q ON q.lang = cuts.lang AND q.phrase = rest
), within AS (
  SELECT lang, part, max(f) AS longer FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[: 2], ' '), array_to_string(string_split(phrase, ' ')[2 :], ' ')]) AS part FROM c WHERE k = 3)
  GROUP BY ALL
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM scored s JOIN totals USING (lang) LEFT JOIN within x ON x.lang = s.lang AND part = phrase
WHERE no = 1 AND (longer IS NULL OR 100 * longer < 50 * a)
QUALIFY rank <= 2000
"""

OP13_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(said, place, start) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), judged AS (
  SELECT host, path, arg_max(place || start, len(place) + len(start)) AS rule, arg_max(said, len(place) + len(start)) AS said
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = place OR host LIKE '%.' || place) AND starts_with(path, start) GROUP BY ALL
), listed AS (
  SELECT DISTINCT host AS key FROM p
  WHERE list_has_any(string_split_regex(host, '[.-]'), ['ads', 'adult', 'bet', 'casino', 'gambling', 'pills', 'porn', 'spam', 'viagra', 'warez'])
), blocked AS (SELECT DISTINCT host FROM p JOIN listed ON host = key OR host LIKE '%.' || key)
SELECT page_id, p.host, p.path, rule, coalesce(said, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN judged j ON p.host = j.host AND p.path = j.path LEFT JOIN blocked b ON p.host = b.host
"""


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (op1_simhash_dedup, op2_language_id, op3_embedding_dedup, op4_token_counts, op5_line_dedup, op6_chat_format, op7_decontaminate, op8_mix_sources, op9_quality, op10_html_text, op11_whitening, op12_collocations, op13_url_filter)
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op8_mix_sources": OP8_SQL, "op12_collocations": OP12_SQL, "op13_url_filter": OP13_SQL}
