"""SimHash near-duplicates, found with pigeonring-filtered segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

BITS = 64
PIECE = 1 << 16  # shingles whose bits are unpacked at once


def _fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()  # bytes: only A-Z, and only the six ASCII breaks
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    return set_fingerprint(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of 64-bit hashes, as a signed number; 0 of an empty one."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PIECE):
        part = hashes[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """64-bit SimHash (long) of a text's word shingles; null and wordless texts give 0."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([_fingerprint(t, width) for t in s], dtype="int64")

    return simhash(text.cast("binary"))


def segments(m: int) -> list[tuple[int, int]]:
    """(offset, bits) of m consecutive segments of a fingerprint, as equal as can be."""
    ends = [BITS * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(ends, ends[1:], strict=False)]


def _mask(parts: list[tuple[int, int]]) -> Column:
    bits = sum(((1 << n) - 1) << at for at, n in parts)
    return F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits).cast("long")


def _diff(a: Column, b: Column, parts: list[tuple[int, int]]) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(_mask(parts)))


def simhash_links(classes: DataFrame, scratch: Scratch, radius: int = 2, most: int = 64) -> DataFrame:
    """Links ``a, b`` between the ids of ``classes`` (fp: distinct fingerprints, rep: id) within ``radius`` bits.

    Pigeonring: with m = 2*radius+1 segments in a ring, two fingerprints within the radius have a segment
    from which every chain of l consecutive segments differs in at most floor(l*radius/m) bits. The chains
    whose budget is zero (the first ``radius`` segments) are the bucket key; the longer chains are checked
    in turn, the last of them being the full Hamming distance.

    Buckets of more than ``most`` fingerprints make no pairs. Their members are joined through midpoints:
    for radius 2 two fingerprints are within the radius just when one-bit flips of both (or they
    themselves) coincide, so all that share such a midpoint are linked to its least id. That gives fewer
    links, but the same components, and grows with the bucket and not its square.
    """
    if radius != 2:
        raise ValueError("midpoints are made for radius 2")
    m = 2 * radius + 1
    ring = segments(m)
    chain = [[ring[(i + j) % m] for j in range(m)] for i in range(m)]
    keyed = classes.where("rep is not null").select(
        "fp",
        "rep",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(_mask(c[:radius])) for c in chain])).alias("i", "key"),
    )
    sized = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = scratch.save(keyed.join(sized, ["i", "key"]))
    few = crowd.where(F.col("n") <= most)
    x, y = few.alias("x"), few.alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    near = F.lit(False)
    for i in range(m):
        viable = F.col("x.i") == i
        for length in range(radius + 1, m + 1):
            viable &= _diff(a, b, chain[i][:length]) <= length * radius // m
        near |= viable
    pairs = x.join(y, (F.col("x.i") == F.col("y.i")) & (F.col("x.key") == F.col("y.key")) & (a < b) & near).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b")
    )
    flips = [F.lit(0).cast("long"), *(_mask([(k, 1)]) for k in range(BITS))]
    mids = (
        crowd.where(F.col("n") > most)
        .select("fp", "rep")
        .distinct()
        .select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("mid"))
    )
    stars = mids.groupBy("mid").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = mids.join(stars, "mid").where("rep <> b").select(F.col("rep").alias("a"), "b")
    return pairs.union(hubs).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints (see :func:`fingerprint`) are computed once and written to the shared folder. Equal ones
    form a class, so a group of copies counts as one fingerprint; classes are linked by
    :func:`simhash_links`, and component_id is the smallest id reachable. Null texts are like empty
    ones (fingerprint 0). Rows without an id get the component of their fingerprint. Repeated ids and rows
    stay as they are. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.save(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")))
    classes = signed.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(simhash_links(classes, scratch), scratch)
    component = classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    component = scratch.save(component)  # so the last join is plain, and a large group of copies can be split
    return signed.join(component, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; columns and repeated rows of kept ids stay.

    Rows without an id can't be told apart and stay.
    """
    groups = simhash_groups(docs, id_col, text_col)
    out = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(out, docs[id_col] == out["__gone"], "left_anti")
