"""Quality scores by similarity-weighted votes of the nearest labelled documents in a latent space."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share

BYTE_SLOTS, SHAPE_SLOTS = 4096, 2048
PIECE = 1 << 20
BLOCK = 256


def _shapes() -> np.ndarray:
    """A class for each byte: letters lower and upper, digits, blanks, breaks, and each sign its own."""
    kind = np.arange(256, dtype=np.uint32)
    kind[ord("a") : ord("z") + 1] = ord("a")
    kind[128:] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("A")
    kind[ord("0") : ord("9") + 1] = ord("0")
    return kind


SHAPES = _shapes()


def _grams(codes: np.ndarray, width: int, slots: int) -> np.ndarray:
    h = np.zeros(max(len(codes) - width + 1, 0), np.uint32)
    for i in range(width):
        h = (h + codes[i : i + len(h)] + np.uint32(1)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
    return np.bincount(h % np.uint32(slots), minlength=slots)


def features(text: bytes | None) -> np.ndarray:
    """Square roots of the relative frequencies of a whole text's byte trigrams and shape quadrigrams, hashed."""
    raw = np.frombuffer(b"\n" + (text or b"") + b"\n", np.uint8)
    grams = np.zeros(BYTE_SLOTS + SHAPE_SLOTS)
    if text:
        for at in range(0, len(raw), PIECE):
            part = raw[at : at + PIECE + 3].astype(np.uint32)
            grams[:BYTE_SLOTS] += _grams(part, 3, BYTE_SLOTS)
            grams[BYTE_SLOTS:] += _grams(SHAPES[part], 4, SHAPE_SLOTS)
        for half in (grams[:BYTE_SLOTS], grams[BYTE_SLOTS:]):
            half /= max(half.sum(), 1)
    return np.sqrt(grams).astype(np.float32)


@dataclass
class Neighbours:
    """Labelled documents in the latent space. All sizes are fixed: slots x rank, sample x rank."""

    weights: np.ndarray  # slots
    basis: np.ndarray  # slots x rank
    points: np.ndarray  # sample x rank, unit length
    labels: np.ndarray  # sample
    prior: float

    def place(self, rows: np.ndarray) -> np.ndarray:
        at = (rows * self.weights) @ self.basis
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)

    def vote(self, at: np.ndarray, k: int, sharp: float) -> np.ndarray:
        """Exact cosines with every point; the k nearest vote with their cosine to the power ``sharp``."""
        near = at @ self.points.T
        if near.shape[1] > k:
            own = np.argpartition(-near, k - 1, axis=1)[:, :k]
            near, labels = np.take_along_axis(near, own, 1), self.labels[own]
        else:
            labels = np.broadcast_to(self.labels, near.shape)
        weight = np.maximum(near, 0) ** sharp
        total = weight.sum(1)
        return np.where(total > 0, (weight * labels).sum(1) / np.maximum(total, 1e-30), self.prior)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 2000,
    rank: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Neighbours | None:
    """Latent-semantic points of a bounded sample of labelled documents; None where there are none.

    Labels of one document are averaged; null labels and null ids are skipped. The sample is ``sample`` documents at
    most, drawn by a hash of the id from all labels. Its hashed features (of fixed size), not its texts, are
    gathered on the driver, where the truncated singular value decomposition is made.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.avg(label_col).alias("label"))
    )
    n = known.count()
    if not n:
        return None
    share = min(1.0, 2.0 * sample / n)
    drawn = known.where(hash_share(F.col("__id"), F.lit(9)) < share)
    drawn = drawn.orderBy(F.xxhash64("__id", F.lit(9)), "__id").limit(sample)

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([features(t).tobytes() for t in s], dtype="object")

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("body"))
    rows = texts.join(F.broadcast(drawn), "__id").select("__id", "label", packed("body").alias("f"))  # at most ``sample``
    got = sorted({(r["__id"], r["label"], bytes(r["f"])) for r in rows.collect()})
    if not got:
        return None
    matrix = np.stack([np.frombuffer(f, np.float32) for _, _, f in got])
    marks = np.array([label for _, label, _ in got], np.float32)
    seen = (matrix > 0).sum(0)
    weights = np.where(seen, np.log((1 + len(got)) / (1 + seen)) + 1, 0).astype(np.float32)
    weighted = matrix * weights
    values, left = np.linalg.eigh((weighted @ weighted.T).astype(np.float64))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9]
    basis = (weighted.T @ (left[:, keep] / np.sqrt(values[keep]))).astype(np.float32)
    model = Neighbours(weights, basis, np.zeros((0, len(keep)), np.float32), marks, float(marks.mean()))
    model.points = model.place(matrix).astype(np.float32)
    return model


def score(text: Column, model: Neighbours, k: int = 32, sharp: float = 8.0) -> Column:
    """Score from 0 to 1 of whole texts; null and empty texts lie nowhere in the space and get the share of label 1."""
    shared = pickle.dumps(model)

    @F.pandas_udf("double")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own: Neighbours = pickle.loads(shared)
        for s in batches:
            parts = [np.zeros(0)]
            for at in range(0, len(s), BLOCK):
                rows = np.stack([features(t) for t in s.iloc[at : at + BLOCK]])
                parts.append(own.vote(own.place(rows), k, sharp))
            yield pd.Series(np.clip(np.concatenate(parts), 0, 1).astype(float))

    return voted(text.cast("binary"))


def with_quality(docs: DataFrame, model: Neighbours | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, which replace columns of those names; without a model both stay at 0."""
    value = F.lit(0.0) if model is None else score(F.col(text_col), model)
    return docs.withColumn("score", value).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
