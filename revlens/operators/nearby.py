"""Points of many groups against each other inside a task: the nearest, those within a radius, and one-to-one picks, without all pairs at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK = 1 << 17  # rows of whole groups that are worked on at once; a larger group makes a chunk of its own
MOST = 1 << 22  # pairs looked at in one go


def starts_of(rows: pa.Table, by: list[str]) -> np.ndarray:
    """Where a group (equal ``by``, nulls alike) of sorted rows starts."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in by:
        c = rows[k].combine_chunks()
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        a, b = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        same = pa.compute.fill_null(pa.compute.equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))
    return np.flatnonzero(new)


def whole_groups(df: DataFrame, by: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], dict], schema: str) -> DataFrame:
    """``work(rows, group)`` over chunks of whole groups of ``df``, in ``order`` within them: many small groups at once, a large one alone. group numbers the rows' groups.

    Groups are dealt out and sorted by Spark. work gives columns by name, as arrays.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    made = to_arrow_schema(StructType.fromDDL(schema))

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        first = starts_of(rows, by)
        group = np.zeros(len(rows), np.int64)
        group[first[1:]] = 1
        out = work(rows, np.cumsum(group))
        arrays = [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names]
        yield from pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, made, strict=True)], schema=made).to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, CHUNK
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < enough:
                continue
            rows = pa.Table.from_batches(held)
            cut = int(starts_of(rows, by)[-1])
            if cut:
                yield from done(rows.slice(0, cut))
            held, n = rows.slice(cut).to_batches(), len(rows) - cut
            enough = max(CHUNK, 2 * n)
        if n:
            yield from done(pa.Table.from_batches(held))

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


class Points:
    """Places (g, x, y): rows of one group and place are one place."""

    def __init__(self, g: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.g, self.x, self.y = g, x, y

    def __len__(self) -> int:
        return len(self.g)

    def at(self, rows: np.ndarray) -> Points:
        return Points(self.g[rows], self.x[rows], self.y[rows])


def places(p: Points, ord_: np.ndarray) -> tuple[Points, list[list]]:
    """Distinct places, and the ords of each in falling order."""
    if not len(p):
        return p, []
    order = np.lexsort((ord_, p.y, p.x, p.g))
    s = p.at(order)
    new = np.r_[True, (s.g[1:] != s.g[:-1]) | (s.x[1:] != s.x[:-1]) | (s.y[1:] != s.y[:-1])]
    first = np.flatnonzero(new)
    ords = ord_[order].tolist()
    ends = [*first[1:].tolist(), len(ords)]
    return s.at(first), [ords[a:b][::-1] for a, b in zip(first.tolist(), ends, strict=True)]


class _Windows:
    """Places ``b`` by group and one axis, so that those about a place lie together."""

    def __init__(self, a: Points, b: Points):
        self.a, self.b, self.axes = a, b, []
        for u, v in ((a.x, b.x), (a.y, b.y)):
            low, high = min(u.min(), v.min()), max(u.max(), v.max())
            self.axes.append((u - low, v - low, high - low))

    def about(self, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Order of b, and of each a the part of it that can be within ``r``; by the axis with fewer pairs, and how many those are."""
        best = None
        for u, v, span in self.axes:
            r_ = min(r, span)
            step = span + 3 * r_ + 1e-300
            ka, kb = u + self.a.g * step, v + self.b.g * step
            slack = r_ + 8 * np.spacing(max(ka.max(), kb.max()))
            order = np.argsort(kb, kind="stable")
            kb = kb[order]
            lo, hi = np.searchsorted(kb, ka - slack, "left"), np.searchsorted(kb, ka + slack, "right")
            n = int((hi - lo).sum())
            if best is None or n < best[3]:
                best = (order, lo, hi, n)
        return best


def _pairs(a: Points, b: Points, r: float, windows: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, distance) of one group within ``r``, in parts; each a's pairs are in one part."""
    order, lo, hi, _ = windows
    n = hi - lo
    total = np.cumsum(n)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MOST, "right")))
        k = n[at:end]
        i = np.repeat(np.arange(at, end), k)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:end], k)]
        same = a.g[i] == b.g[j]
        i, j = i[same], j[same]
        d = np.hypot(a.x[i] - b.x[j], a.y[i] - b.y[j])
        near = d <= r
        yield i[near], j[near], d[near]
        at = end


def within(a: Points, b: Points, r: float) -> np.ndarray:
    """Of each a whether some b of its group is within ``r``."""
    found = np.zeros(len(a), bool)
    if len(a) and len(b):
        for i, _, _ in _pairs(a, b, r, _Windows(a, b).about(r)):
            found[i] = True
    return found


def nearest(a: Points, b: Points, rank: np.ndarray, r: float) -> np.ndarray:
    """Of each a the nearest b of its group (-1: there is none); of equally near ones that of the least ``rank``. Looks within ``r`` first, then ever farther."""
    found = np.full(len(a), -1)
    if not len(a) or not len(b):
        return found
    left = np.flatnonzero(np.isin(a.g, b.g))
    far = np.hypot(*[max(u.max(), v.max()) - min(u.min(), v.min()) for u, v in ((a.x, b.x), (a.y, b.y))]) * (1 + 1e-9) + 1e-300
    while len(left):
        some = a.at(left)
        w = _Windows(some, b)
        windows = w.about(r)
        while windows[3] > MOST and r > far / (1 << 30) and r < far:
            smaller = w.about(r / 2)
            if smaller[3] > 0.9 * windows[3]:
                break
            r, windows = r / 2, smaller
        for i, j, d in _pairs(some, b, r, windows):
            order = np.lexsort((rank[j], d, i))
            i, j = i[order], j[order]
            first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
            found[left[i[first]]] = j[first]
        if r >= far:
            break
        left = left[found[left] < 0]
        r = min(2 * r, far)
    return found


def pick(group: np.ndarray, score: np.ndarray, o: np.ndarray, n: np.ndarray, olds: list[list], news: list[list], taken: list) -> None:
    """Pairs of ords taken by rising score in each group, ties by the new and then the old ord; o and n are places, whose ords left (falling) shrink."""
    order = np.lexsort((score, group))
    g, s, o, n = (c[order].tolist() for c in (group, score, o, n))
    at = 0
    while at < len(s):
        end = at + 1
        while end < len(s) and s[end] == s[at] and g[end] == g[at]:
            end += 1
        if end == at + 1:
            a, b = olds[o[at]], news[n[at]]
            for _ in range(min(len(a), len(b))):
                taken.append((g[at], a.pop(), b.pop()))
        else:
            near: dict[int, list[int]] = {}
            for k in range(at, end):
                if olds[o[k]] and news[n[k]]:
                    near.setdefault(n[k], []).append(o[k])
            for _, j in sorted((w, j) for j in near for w in news[j]):
                best = min((i for i in near[j] if olds[i]), key=lambda i: olds[i][-1], default=None)
                if best is not None:
                    taken.append((g[at], olds[best].pop(), news[j].pop()))
        at = end


def assigned(old: Points, new: Points, old_ord: np.ndarray, new_ord: np.ndarray, limit: np.ndarray) -> list[tuple]:
    """(group, old ord, new ord): each side once in each group, by rising distance up to the group's ``limit``; ties by the new, then the old ord.

    All within a radius are picked before anything farther is looked at, so what is left is apart from each other and no round has many pairs.
    """
    taken: list[tuple] = []
    a, olds = places(old, old_ord)
    b, news = places(new, new_ord)
    most = float(limit.max()) if len(limit) else 0.0
    r = most / 64
    while len(a) and len(b):
        open_a = np.flatnonzero(np.fromiter(map(bool, olds), bool, len(olds)) & np.isin(a.g, b.g))
        open_b = np.flatnonzero(np.fromiter(map(bool, news), bool, len(news)) & np.isin(b.g, a.g))
        if not len(open_a) or not len(open_b):
            break
        p, q = a.at(open_a), b.at(open_b)
        w = _Windows(p, q)
        windows = w.about(r)
        while windows[3] > MOST and r > most / (1 << 30):
            smaller = w.about(r / 2)
            if smaller[3] > 0.9 * windows[3]:
                break
            r, windows = r / 2, smaller
        parts = [(i, j, d) for i, j, d in _pairs(p, q, r, windows)]
        i, j, d = (np.concatenate(c) for c in zip(*parts, strict=True))
        ok = d <= limit[p.g[i]]
        i, j, d = i[ok], j[ok], d[ok]
        pick(p.g[i], d, open_a[i], open_b[j], olds, news, taken)
        if r >= most:
            break
        r = min(2 * r, most)
    return taken
