"""Whitening of embeddings: a randomised range finder over all centred rows, and Rayleigh-Ritz components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
SAFE = 1 << 62  # below it, sums and products stay 64-bit integers; beyond, Python's integers take over
CHUNK = 64  # columns of a matrix that are summed in one row
MOST = 4096  # rows that a task multiplies at a time


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """x of a batch: floor(64 * c) + 1000000 as long integers (held at +-2^62 where an entry is beyond that)."""
    c = batch["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -float(SAFE), float(SAFE)).astype(np.int64) + SHIFT


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """``x``, as Python's integers if ``most`` (a bound of what will be made of it) needs more than 64 bits."""
    return x if most < SAFE else x.astype(object)


@dataclass
class Whitening:
    """What whitens vectors of ``dim`` entries: all of it is bounded by dim, whatever the number of rows."""

    dim: int
    n: int
    sums: list[int]
    eigenvalues: np.ndarray  # falling
    components: np.ndarray  # dim x k, unit columns; the entry of greatest size in each is positive
    trace: float
    passes: int
    full: bool  # whether the range finder had to take all dimensions
    identity_error: float | None = None

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remainder of the means, so that subtracting them from x loses nothing."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2; null where that is no long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        d = _exact(x, most) * self.n - np.array(self.sums, np.int64 if most < SAFE else object)
        far = int(np.abs(d).max(initial=0))
        sums = (_exact(d, far * far * max(self.dim, 1)) ** 2).sum(1)
        return [int(s) if s < 1 << 63 else None for s in sums]


def _summed(vectors: DataFrame, dim: int, made: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum of ``made(x)`` (height x width doubles) over all batches of rows x: one matrix a task, summed by Spark in rows of up to 64."""
    chunks = -(-width // CHUNK)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, chunks * CHUNK))
        for batch in batches:
            for lo in range(0, batch.num_rows, MOST):
                total[:, :width] += made(_rows(batch.slice(lo, MOST), dim))
        flat = total.reshape(height * chunks, CHUNK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), *[pa.array(flat[:, j]) for j in range(CHUNK)]], ["at", *[f"c{j}" for j in range(CHUNK)]]
        )

    parts = vectors.mapInArrow(work, "at long, " + ", ".join(f"c{j} double" for j in range(CHUNK)))
    rows = parts.groupBy("at").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(CHUNK)]).toArrow()
    out = np.zeros((height * chunks, CHUNK))
    out[rows["at"].to_numpy()] = np.stack([rows[f"c{j}"].to_numpy() for j in range(CHUNK)], axis=1)
    return out.reshape(height, chunks * CHUNK)[:, :width]


def _sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the sums of x, exactly: sums of batches as two halves of 32 and more bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            x = _rows(batch, dim)
            n, total = n + len(x), total + _exact(x, len(x) * int(np.abs(x).max(initial=0))).sum(0).astype(object)
        low = [int(t) & 0xFFFFFFFF for t in total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, dim)), pa.array([n, *low], pa.int64()), pa.array([0, *(int(t) >> 32 for t in total)], pa.int64())], ["at", "low", "high"]
        )

    rows = vectors.mapInArrow(work, "at long, low long, high long").groupBy("at").agg(F.sum("low").alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"))
    got = {r["at"]: r["low"] + (int(r["high"]) << 32) for r in rows.collect()}
    return got.get(-1, 0), [got.get(j, 0) for j in range(dim)]


def usable(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` without those that are null or hold null or non-finite entries."""
    finite = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.coalesce(finite, F.lit(False)))


def fit_whitening(
    vectors: DataFrame, dim: int, k: int = 32, oversample: int = 8, passes: int = 3, tolerance: float = 1e-11, seed: int = 11, vec_col: str = "embedding"
) -> Whitening | None:
    """The first ``k`` components of all rows of ``vectors``, each of ``dim`` finite entries; None without rows or dimensions.

    Random directions, ``k + oversample`` of them, are multiplied by the covariance, a pass over all centred rows each time, and made
    orthonormal. Every pass also gives Rayleigh-Ritz pairs and their residuals. They are taken once every residual, over the gap to the
    next eigenvalue, is below ``tolerance``. If ``passes`` passes don't bring that, which is so for spectra that hardly fall, all dimensions are
    taken, and the pairs are those of the covariance itself. Components of no variance (all rows alike) are left out.
    """
    rows = vectors.select(F.col(vec_col).alias("vec"))
    n, sums = _sums(rows, dim) if dim else (0, [])
    if not n:
        return None
    model = Whitening(dim, n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0, False)
    width = min(dim, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0] if width < dim else np.eye(dim)
    while True:
        model.full = basis.shape[1] == dim

        def product(x: np.ndarray, basis: np.ndarray = basis) -> np.ndarray:
            c = model.centred(x)
            return np.concatenate([c.T @ (c @ basis), (c * c).sum(0)[:, None]], axis=1)

        got = _summed(rows, dim, product, dim, basis.shape[1] + 1) / n
        image, model.trace = got[:, :-1], float(got[:, -1].sum())
        model.passes += 1
        small = basis.T @ image
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1], w[:, ::-1]
        found = min(k, len(e))
        if model.full:
            break
        residual = np.linalg.norm(image @ w - basis @ w * e, axis=0)[:found]
        gaps = np.minimum(np.abs(np.diff(e, prepend=np.inf)), np.abs(np.diff(e, append=0.0)))[:found]
        if (residual <= tolerance * np.maximum(gaps, 1e-300)).all():
            break
        basis = np.linalg.qr(image)[0] if model.passes < passes else np.eye(dim)
    found = min(found, int(np.count_nonzero(e > model.trace * dim * 2.0**-48)))
    u = basis @ w[:, :found]
    model.eigenvalues, model.components = e[:found], u * np.where(u[np.abs(u).argmax(0), np.arange(found)] < 0, -1, 1)
    return model


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance (over all rows) minus the identity: one more pass over the rows."""
    k = len(model.eigenvalues)

    def product(x: np.ndarray) -> np.ndarray:
        z = model.whitened(x)
        return np.concatenate([z.T @ z, z.sum(0)[:, None]], axis=1)

    got = _summed(vectors.select(F.col(vec_col).alias("vec")), model.dim, product, k, k + 1) / model.n
    mean = got[:, -1]
    return float(np.abs(got[:, :-1] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def with_whitened(vectors: DataFrame, k: int = 32, vec_col: str = "embedding", **fit) -> DataFrame:
    """The usable ``vectors`` with ``n, deviation, whitened, explained, identity_error``; whitened and explained are arrays, an entry for each component.

    An entry c counts as x = floor(64 * c) + 1000000, a long. n is the number of vectors fitted, deviation the exact sum of (n * x - S)^2 (null if it is no
    long), whitened the centred x projected on the components, over the roots of their eigenvalues, explained the eigenvalues' shares of the trace.
    See :func:`fit_whitening`; ``fit`` goes there.

    Vectors that are null or hold null, NaN or infinite entries go. Repeated rows count each time. Vectors of different lengths are
    lists of their own, each with its own fit; empty ones, and rows that are all alike, have no components (empty arrays). An empty table gives an empty one.
    Columns of the five names are replaced.
    """
    names = ("n", "deviation", "whitened", "explained", "identity_error")
    rows = usable(vectors, vec_col).drop(*names)
    dims = [r["dim"] for r in rows.groupBy(F.size(vec_col).alias("dim")).count().orderBy("dim").collect()]  # as many as there are embedding models
    kept = rows.columns
    at = "__x"
    made = []
    for dim in dims:
        own = rows.where(F.size(vec_col) == dim)
        model = fit_whitening(own, dim, k, vec_col=vec_col, **fit)
        if model is None:
            empty = F.array().cast("array<double>")
            made.append(own.select(*kept, F.lit(own.count()).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), empty.alias("whitened"), empty.alias("explained"), F.lit(0.0).alias("identity_error")))
            continue
        made.append(_applied(own, model, identity_error(own, model, vec_col), vec_col, kept, at))
    if not made:
        zero = rows.select(*kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(names, ("long", "long", "array<double>", "array<double>", "double"), strict=True)])
        return zero.where("false")
    out = made[0]
    for other in made[1:]:
        out = out.union(other)
    return out


def _applied(rows: DataFrame, model: Whitening, error: float, vec_col: str, kept: list[str], at: str) -> DataFrame:
    @F.pandas_udf("struct<deviation:long,whitened:array<double>>")
    def whiten(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            made: list[np.ndarray] = []
            deviations: list[int | None] = []
            for lo in range(0, len(s), MOST):
                c = np.stack(s.iloc[lo : lo + MOST].to_list()).astype(np.float64)
                x = np.clip(np.floor(SCALE * c), -float(SAFE), float(SAFE)).astype(np.int64) + SHIFT
                made.extend(model.whitened(x))
                deviations += model.deviation(x)
            yield pd.DataFrame({"deviation": pd.array(deviations, "Int64"), "whitened": made})

    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    seen = rows.withColumn(at, whiten(vec_col))
    return seen.select(
        *kept, F.lit(model.n).cast("long").alias("n"), F.col(f"{at}.deviation").alias("deviation"), F.col(f"{at}.whitened").alias("whitened"),
        shares.alias("explained"), F.lit(error).alias("identity_error"),
    )
