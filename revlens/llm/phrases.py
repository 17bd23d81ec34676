"""Phrase collocations: word suffix arrays of shards give n-gram counts, which are merged by key over the whole corpus."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch

SHARD_BYTES = 1 << 20
FILTER_BITS = 1 << 26  # of the filter of frequent phrases: 8 MB, whatever the corpus
SALTS = 16
BREAK = b"\xff"  # in no UTF-8 text
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10)
COUNTED = "lang string, phrase string, f long"


class _Ids(dict):
    """Word ids in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def suffix_array(x: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Places of ``x`` (word ids, 0: a break; it ends with a break) in the order of the ``depth`` ids from there on, or more.

    Prefix doubling: ranks by h ids, paired with the ranks h places on, give those by 2h. Of the last order only ``starts``
    (a mask) are needed.
    """
    rank, h = x, 1
    while True:
        behind = np.concatenate([rank[h:], np.full(min(h, len(rank)), rank[-1])])
        key = rank * (rank.max() + 1) + behind
        if 2 * h >= depth:
            at = np.arange(len(x)) if starts is None else np.flatnonzero(starts)
            return at[np.argsort(key[at], kind="stable")]
        rank, h = np.unique(key, return_inverse=True)[1], 2 * h


def ngram_counts(x: np.ndarray, n_from: int, n_to: int, starts: np.ndarray | None = None, old: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: where an n-gram of ``x`` stands first in the suffix array, and how often it occurs.

    n-grams hold no break. Neighbours in the suffix array with n or more common ids are one interval of its LCP array, and so one
    n-gram. ``starts`` masks the places that count. n-grams that end in the first ``old`` ids have been counted before.
    """
    x = np.concatenate([x, np.zeros(n_to, x.dtype)])
    if starts is not None:
        starts = np.concatenate([starts, np.zeros(n_to, bool)])
    sa = suffix_array(x, n_to, starts)
    words, common, alike = np.zeros(len(sa), np.int8), np.zeros(len(sa), np.int8), np.ones(len(sa), bool)
    inside = np.ones(len(sa), bool)
    alike[:1] = False
    for j in range(n_to):
        here = x[np.minimum(sa + j, len(x) - 1)]
        inside &= here != 0
        words += inside
        alike[1:] &= (here[1:] == here[:-1]) & inside[1:]
        common += alike
    out = []
    for n in range(n_from, n_to + 1):
        counts = (words >= n) & (sa + n > old)
        heads = np.flatnonzero((words >= n) & (common < n))
        if not len(heads):
            out.append((heads, heads))
            continue
        f = np.add.reduceat(counts.astype(np.int64), heads)
        out.append((sa[heads[f > 0]], f[f > 0]))
    return out


def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
    """A hash of a phrase from those of its words."""
    h = hashes[0]
    for other in hashes[1:]:
        h = ((h << np.uint64(1)) | (h >> np.uint64(63))) ^ other
    return h


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    return [h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)]


def _counted(text: bytes, lang: str, old: int, n_from: int, n_to: int, bloom: np.ndarray | None) -> pa.RecordBatch:
    """n-grams of a shard; with a filter of frequent (n - 1)-grams, only those of which both are in it."""
    ids = _Ids({BREAK: 0})
    tokens = text.split()
    x = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    vocabulary = pa.array(list(ids), pa.binary())
    starts = None
    if bloom is not None:
        by_word = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in ids), np.uint64, len(ids))
        h, m = by_word[x], n_to - 1
        frequent = np.zeros(len(x), bool)
        if len(x) >= m:
            seen = _mixed([h[j : len(x) - m + 1 + j] for j in range(m)])
            frequent[: len(seen)] = np.logical_and.reduce([bloom[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1 == 1 for b in _bits(seen, 8 * len(bloom))])
        starts = frequent.copy()
        starts[:-1] &= frequent[1:]
        starts[-1:] = False
    phrases, counts = [], []
    for n, (at, f) in zip(range(n_from, n_to + 1), ngram_counts(x, n_from, n_to, starts, old), strict=True):
        parts = [vocabulary.take(pa.array(x[at + j])) for j in range(n)]
        phrases.append(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if n > 1 else parts[0])
        counts.append(f)
    if n_from == 1:
        phrases.append(pa.array([b""], pa.binary()))
        counts.append(np.array([np.count_nonzero(x[old:])]))
    said, f = pa.concat_arrays(phrases), np.concatenate(counts)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(f), np.int64))), said.view(pa.string()), pa.array(f, pa.int64())], schema=schema)


def _pieces(text: bytes, n_to: int, most: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts cut between words, each after the last n_to - 1 words before it, and how many those are."""
    carry, at = [], 0
    while True:
        cut = re.compile(rb"[ \t\xff]").search(text, at + most)
        part = text[at : cut.start() if cut else len(text)].replace(BREAK, b" \xff ")
        yield b" ".join([*carry, part]), len(carry)
        if not cut:
            return
        tail = part[-4096:] if len(part) > 4096 else part
        words = tail.split() if len(tail) == len(part) or len(tail.split()) > n_to else part.split()
        carry, at = ([*carry, *words])[-(n_to - 1) :] if n_to > 1 else [], cut.start()


def _counts(n_from: int, n_to: int, bloom: np.ndarray | None, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of texts: those of one language together up to ``most`` bytes, longer ones in parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                yield _counted(b" \xff ".join(texts), lang, 0, n_from, n_to, bloom)
            held.clear()

        for batch in batches:
            langs, texts = batch["lang"], batch["text"].cast(pa.binary())
            for i in range(batch.num_rows):  # one text at a time: a batch holds thousands
                lang, text = langs[i].as_py(), (texts[i].as_py() or b"").translate(PLAIN)
                if len(text) > most:
                    for part, old in _pieces(text, n_to, most):
                        yield _counted(part, lang, old, n_from, n_to, bloom)
                    continue
                held.setdefault(lang, []).append(text.replace(BREAK, b" \xff "))
                size += len(text) + 64
                if size > most:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return count


def _bloom(phrases: DataFrame, size: int) -> np.ndarray:
    """Bytes of a filter of ``size`` bits over ``phrase``; all bits of the driver's copy come from at most size / 64 rows."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [p.encode().split(b" ") for p in batch["phrase"].to_pylist()]
            if not split:
                continue
            hashes = [np.fromiter((xxhash.xxh64_intdigest(w[j], 42) for w in split), np.uint64, len(split)) for j in range(len(split[0]))]
            at = np.concatenate(_bits(_mixed(hashes), size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "bits"])

    words = phrases.select("phrase").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    filled = np.zeros(size // 64, np.int64)
    rows = words.toArrow()
    filled[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return filled.view(np.uint8)


def phrase_counts(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang",
    shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS, scratch: Scratch | None = None,
) -> DataFrame:
    """``lang, phrase, f``: all phrases of 1 to ``max_words`` words that occur ``min_count`` times in a language, and its number of words under the empty phrase.

    Texts (null: empty) have A-Z lower-cased and are cut at ``.,;:!?`` and line breaks into pieces, and those at blanks and tabs
    into words. A null language is ``und``. Shards of ``shard_bytes`` are counted on their own by a suffix array, and the counts summed by key, so
    no phrase is held by one task, however common. Phrases of n words beyond two take another pass each, over places where both
    phrases of n - 1 words are frequent: none else can be. A filter of fixed size tells those, and what it lets through by mistake, more
    and more of it as it fills, costs time alone. Repeated rows count each time; an empty table has no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found, bloom, n = None, None, min(2, max_words)
    while True:
        counted = texts.mapInArrow(_counts(n if bloom is not None else 1, n, bloom, shard_bytes), COUNTED)
        merged = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        merged = scratch.save(merged.where((F.col("f") >= min_count) | (F.col("phrase") == "")))
        found = merged if found is None else found.union(merged)
        if n >= max_words:
            return found
        bloom = _bloom(merged.where(F.size(F.split("phrase", " ")) == n), filter_bits)
        n += 1


def _part(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, covered: int = 50,
    text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``max_words`` words by how much their parts belong together.

    a is how often the phrase occurs (``min_count`` at least), n the language's words (:func:`phrase_counts`). A cut after k words gives l and r, the
    counts of both parts, and floor(1000000 * a * a / (l * r)) in decimals of 38 digits, exact while a stays below 10^15; the cut with the lowest
    score counts, of equal ones the first. A phrase goes that stands within a longer one (of those counted) which makes up
    ``covered`` per cent of its occurrences. Order: score, a, both falling, then the phrase by bytes. Texts without words, null texts and an empty
    table have no phrases.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(phrase_counts(docs, max_words, min_count, text_col, lang_col, shard_bytes, filter_bits, scratch))
    words = F.split("phrase", " ")
    phrases = counts.withColumn("words", words).where(F.size("words") >= 2)
    k, m = F.col("k"), F.size("words")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), F.lit(1), k).alias("left"), _part(F.col("words"), k + 1, m - k).alias("right"))
    part = lambda side, f: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    if max_words > 2:
        # (begin, words) of every phrase of two words or more within a longer one
        spans = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda n: F.transform(F.sequence(F.lit(1), m - n + 1), lambda at: _part(words, at, n))))
        within = phrases.where(m >= 3).select("lang", "f", F.explode(spans).alias("phrase"))
        longest = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        scored = scored.join(longest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    # The best of each salt, then of those, so that a language's phrases never meet in one task.
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
