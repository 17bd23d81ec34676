"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact shingle similarity."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
BLOCKS, BLOCK_BITS = 8, 8
CACHE = 1 << 18
PIECE = 2048
BITS_SET = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    """Hashes of words, kept up to a fixed number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Word shingles of texts as 64-bit hashes."""

    def __init__(self, width: int):
        self.width = width
        self.known = _WordHashes()

    def words(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """One hash for each window of ``width`` words; a shorter text is one shingle, an empty one none."""
        n = len(words)
        if not n:
            return words
        width = min(self.width, n)
        h = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            h = _mixed(h + words[i : n - width + 1 + i])
        return h


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def window_prints(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash (rows of 8 bytes) of the windows of ``size`` shingles at ``starts`` (sorted), from running bit counts."""
    out = []
    at = 0
    while at < len(starts):
        stop = int(np.searchsorted(starts, starts[at] + PIECE))
        own = starts[at:stop] - starts[at]
        sums = np.zeros((int(own[-1]) + size + 1, 64), np.int32)
        np.cumsum(_bits(h[starts[at] : starts[at] + own[-1] + size]), axis=0, out=sums[1:])
        out.append(np.packbits(2 * (sums[own + size] - sums[own]) > size, axis=1, bitorder="little"))
        at = stop
    return np.concatenate(out)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets of shingles: common weight over united weight, weights being counts."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(a) + len(b) - common)


class Index:
    """Benchmark items by size in words, with their fingerprints in Hamming blocks."""

    def __init__(self, items: list[tuple[int, str]], width: int, similarity: float, radius: int):
        self.shingler = Shingler(width)
        self.width, self.similarity, self.radius = width, similarity, radius
        self.reach = radius // BLOCKS  # pigeonhole: some block differs in no more bits
        self.by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        everything = [np.zeros(0, np.uint64)]
        for item, text in items:
            words = self.shingler.words(text)
            if len(words):
                h = self.shingler.shingles(words)
                self.by_size.setdefault(len(words), []).append((item, h))
                everything.append(h)
        self.known = np.unique(np.concatenate(everything))
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = {
            n: np.concatenate([window_prints(h, np.zeros(1, np.int64), len(h)) for _, h in own])
            for n, own in self.by_size.items()
        }
        self.near = {}
        values = np.arange(256, dtype=np.uint8)
        for n, prints in self.prints.items():
            away = BITS_SET[values[:, None, None] ^ prints[None, :, :]]
            self.near[n] = away <= self.reach  # block value x item x block

    def matches(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window of each item that the text holds.

        Windows have the size of an item (a shorter text is one window), at every place. Since the similarity asks for so many common
        shingles, windows with fewer shingles that occur in the benchmark at all are passed over; none that could
        match is lost by it. The others' fingerprints are looked up in the blocks, checked in full, and verified.
        """
        words = self.shingler.words(text or "")
        if not len(words) or not self.by_size:
            return []
        best: dict[int, tuple[float, int]] = {}
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, own in self.by_size.items():
            width = min(self.width, n)
            if len(words) < width:
                continue
            if width not in by_width:
                h = Shingler(width).shingles(words)
                hit = self.hint.take((h & np.uint64((1 << 20) - 1)).view(np.int64))
                at = np.nonzero(hit)[0]
                place = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
                hit[at] = self.known[place] == h[at]
                total = int(np.count_nonzero(hit[at]))
                by_width[width] = h, total, np.concatenate([[0], np.cumsum(hit)]) if total else None
            h, total, hits = by_width[width]
            least = int(np.ceil(self.similarity * (n - width + 1) - 1e-9))
            size = min(n, len(words)) - width + 1
            if total < max(least, 1):
                continue
            starts = np.nonzero(hits[size:] - hits[:-size] >= least)[0]
            if not len(starts):
                continue
            prints = window_prints(h, starts, size)
            for at in range(0, len(starts), PIECE):
                part = prints[at : at + PIECE]
                close = np.zeros((len(part), len(own)), bool)
                for block in range(BLOCKS):
                    close |= self.near[n][part[:, block], :, block]
                w, i = np.nonzero(close)
                full = BITS_SET[part[w] ^ self.prints[n][i]].sum(axis=1) <= self.radius
                for k, item in zip(w[full], i[full], strict=True):
                    start = int(starts[at + k])
                    value = weighted_similarity(h[start : start + size], own[item][1])
                    if value >= self.similarity and (value, -start) > best.get(own[item][0], (-1.0, 0)):
                        best[own[item][0]] = value, -start
        return [(item, value, -start) for item, (value, start) in sorted(best.items())]


def _found(text: Column, items: list[tuple[int, str]], width: int, similarity: float, radius: int) -> Column:
    packed = pickle.dumps(items)

    @F.pandas_udf("array<struct<item_id:long,similarity:double,start:long>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(pickle.loads(packed), width, similarity, radius)
        for s in batches:
            yield pd.Series(
                [[{"item_id": i, "similarity": v, "start": p} for i, v, p in index.matches(t)] for t in s],
                dtype="object",
            )

    return found.asNondeterministic()(text)  # else filters on the result may run it a second time


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    radius: int = 20,
    width: int = 5,
    text_col: str = "text",
    slice_chars: int = 4_000_000,
) -> DataFrame:
    """``docs`` with ``leaks``: array of struct(item_id, similarity, start), one entry for each benchmark item held.

    A document holds an item if some window of as many words as the item has is within ``radius`` bits of it by SimHash
    and its ``width``-word shingles (lower-cased letters and digits; all words of a shorter item) have a
    weighted Jaccard similarity of at least ``similarity``; of the best windows the first is named. Null and
    wordless texts hold nothing, nor does anything hold a null or wordless item. Repeated rows stay; other
    columns are kept, and one named leaks is replaced.

    The benchmark goes to the workers in slices of at most ``slice_chars`` characters (or one item), each looked up
    in a pass of its own over the documents; a benchmark within that size takes one pass.
    """
    items = benchmark.where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-total // (slice_chars // 2))) if total > slice_chars else 1
    leaks = F.array().cast("array<struct<item_id:long,similarity:double,start:long>>")
    for k in range(slices):
        own = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        rows = sorted((r["item_id"], r["text"]) for r in own.select(F.col("item_id").cast("long"), "text").collect())
        if rows:
            leaks = F.concat(leaks, _found(F.col(text_col), rows, width, similarity, radius))
    return docs.withColumn("leaks", leaks)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; see :func:`with_leaks`."""
    return with_leaks(docs, benchmark, **options).where(F.size("leaks") == 0).drop("leaks")
