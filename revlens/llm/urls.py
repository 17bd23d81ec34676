"""Judging URLs by rules and by an exact block list held in a cascade of Bloom filters, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BITS_A_KEY = 8
HASHES = 5
MOST_BITS = 1 << 28  # of one slice's filters, 32 MB: what a task holds at a time
PARTS = r"(?s)://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def keys_of(host: Column, path: Column) -> Column:
    """What a list can name of a url: its host, the domains above that, and host and path together. None for an empty host."""
    labels = F.split(host, r"\.")
    above = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    page = F.filter(F.array(F.concat(host, path)), lambda k: path != "")
    return F.when(host != "", F.concat(above, page)).otherwise(F.array().cast("array<string>"))


def _bits(level: int, key: Column, size: int) -> list[Column]:
    """The bits of a key in a level's filter of ``size`` bits; each level has hashes of its own."""
    h = F.xxhash64(F.lit(level), key)
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    step = F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [(low + step * j) % size for j in range(HASHES)]


def _has(level: int, key: Column, words: Column, first: int, size: int) -> Column:
    """Whether the filter that starts at word ``first`` holds all bits of a key."""
    tests = [
        F.getbit(F.get(words, (F.lit(first) + F.shiftright(bit, 6)).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        for bit in _bits(level, key, size)
    ]
    out = tests[0]
    for t in tests[1:]:
        out &= t
    return out


class Cascade:
    """Filters in turn: the first holds the listed keys, each next one the keys that pass the one before by mistake.

    ``filters`` is one row with all of them as an array of 64-bit words; ``sizes`` has the bits of each. Membership is exact
    for every key of the universe it was built over, and undefined for others.
    """

    def __init__(self, filters: DataFrame | None, sizes: Sequence[int]):
        self.filters, self.sizes = filters, list(sizes)

    def has(self, key: Column, words: Column) -> Column:
        """Whether ``key`` is listed; ``words`` is the array of ``filters``. The first filter without the key decides."""
        out = F.lit(len(self.sizes) % 2 == 1)
        first = sum(self.sizes) // 64
        for level in range(len(self.sizes) - 1, -1, -1):
            first -= self.sizes[level] // 64
            passed = _has(level, key, words, first, self.sizes[level])
            out = F.when(~passed, F.lit(level % 2 == 1)).otherwise(out)
        return out


def _filter(keys: DataFrame, level: int, size: int) -> DataFrame:
    """``word, bits`` of a filter of ``size`` bits over ``keys``."""
    bit = F.explode(F.array(*_bits(level, F.col("key"), size))).alias("bit")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    return keys.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits"))


def _in_line(parts: DataFrame, size: int) -> DataFrame:
    """One row: the words 0 to size / 64 - 1 of ``parts`` in order, zero where it has none. Gathered in blocks of 4,096."""
    spark = parts.sparkSession
    words = parts.union(spark.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))

    def strung(at: str, part: str) -> Column:
        return F.sort_array(F.collect_list(F.struct(at, part))).getField(part)

    blocks = words.groupBy(F.shiftright("word", 12).alias("block")).agg(strung("word", "bits").alias("bits"))
    return blocks.agg(F.flatten(strung("block", "bits")).alias("words"))


def build_cascade(keys: DataFrame, scratch: Scratch) -> Cascade:
    """The cascade of a universe ``key, listed`` (distinct keys, saved): levels until no key passes by mistake.

    A level holds BITS_A_KEY bits for each of its keys, and about 2 in 100 of the others pass it, so sizes fall quickly. Only
    their counts reach the driver.
    """
    held, other = keys.where("listed").select("key"), keys.where(~F.col("listed")).select("key")
    n = held.count()
    sizes: list[int] = []
    rows: DataFrame | None = None
    while n:
        level, size = len(sizes), 64 * (-(-n * BITS_A_KEY // 64))
        first = sum(sizes) // 64
        row = scratch.save(_in_line(_filter(held, level, size), size))
        passed = other.withColumn("__words", row.scalar()).where(_has(level, F.col("key"), F.col("__words"), 0, size))
        passed = scratch.save(passed.select("key"))
        rows = row if rows is None else rows.select(F.concat("words", row.scalar()).alias("words"))
        assert first == sum(sizes) // 64
        sizes.append(size)
        held, other, n = passed, held, passed.count()
    return Cascade(scratch.save(rows) if rows is not None else None, sizes)


def with_listed(
    rows: DataFrame, keys: Column, listed: DataFrame, scratch: Scratch, name: str = "listed", most_bits: int = MOST_BITS
) -> DataFrame:
    """``rows`` and a boolean ``name``: whether one of their ``keys`` (an array of strings) is in ``listed`` (its first column).

    Universe: all keys of ``rows``, one pass with partial aggregation that also marks the listed ones; listed keys that no row has
    take no room. Rows are then judged without a join: a task holds the filters alone. Where those would be over ``most_bits``, the
    keys are dealt by hash into as many slices as keep below it, and rows take a pass for each slice.

    Null keys are in no list; an empty list marks nothing; a row without keys isn't listed. Repeated rows fare alike.
    """
    rows = scratch.save(rows.withColumn("__keys", keys))
    named = listed.toDF(*["key", *[f"__{i}" for i in range(1, len(listed.columns))]]).select("key", F.lit(False).alias("here"), F.lit(True).alias("listed"))
    met = rows.select(F.explode("__keys").alias("key"), F.lit(True).alias("here"), F.lit(False).alias("listed"))
    marked = met.union(named).where("key is not null").groupBy("key").agg(F.max("here").alias("here"), F.max("listed").alias("listed"))
    universe = scratch.save(marked.where("here").select("key", "listed"))
    n, n_listed = universe.agg(F.count(F.lit(1)), F.count_if("listed")).first()
    slices = max(1, -(-BITS_A_KEY * (n_listed + n // 20) * 5 // 4 // most_bits))
    slice_of = lambda key: F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(slices))
    rows = rows.withColumn(name, F.lit(False))
    for k in range(slices):
        part = universe if slices == 1 else universe.where(slice_of(F.col("key")) == k)
        cascade = build_cascade(part, scratch)
        if cascade.filters is None:
            continue
        mine = F.col("__keys") if slices == 1 else F.filter("__keys", lambda key: slice_of(key) == k)  # noqa: B023
        rows = rows.withColumn("__words", cascade.filters.scalar())
        hit = F.exists(mine, lambda key: F.coalesce(cascade.has(key, F.col("__words")), F.lit(False)))  # noqa: B023
        rows = rows.withColumn(name, F.col(name) | hit).drop("__words")
        if k + 1 < slices:
            rows = scratch.save(rows)
    return rows.drop("__keys")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) by the longest rule that fits, else nulls. rules: (allow or block, host, path), a short list.

    A rule fits its host and everything below that, where the path starts with the rule's. Of equally long ones that with the longer
    host counts, then the earlier.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, start in reversed(sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(at + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    url_col: str = "url",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``: the longest fitting rule decides, else whether the url is listed.

    ``listed`` names (first column) hosts, domains with all below them, or single pages as host and path; see :func:`with_listed`.
    A url that is null or has no ``://`` has an empty host and path; no rule fits it, and it is allowed. Of columns with the
    four names above, the new ones stay. An empty table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*own, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    seen = with_listed(parts, keys_of(F.col("host"), F.col("path")), listed, scratch, "__listed", most_bits)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow"))
    return seen.select(*own, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def hosts_named(pages: DataFrame, words: Sequence[str], url_col: str = "url") -> DataFrame:
    """``key``: the hosts of ``pages`` that have one of ``words`` as a part of their name (parts end at dots and hyphens)."""
    host = host_of(F.col(url_col))
    parts = F.split(host, r"[.\-]")
    return pages.select(host.alias("key"), parts.alias("parts")).where(F.arrays_overlap("parts", F.array(*map(F.lit, words)))).select("key").distinct()
