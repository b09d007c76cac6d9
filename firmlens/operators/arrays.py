"""Moments and exact quantiles of many columns at once that come as matrices inside the tasks, without a row per value.

A column here is a place of a fixed-width array: a draw of a model, a coefficient of a key. Their number is the design's, so what
is kept for them, counts and bounds but never values, may meet on the driver; rows stay in their tasks and are read once a round.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BINS = 512  # intervals that a round cuts a bracket into
BOUND = 1 << 15  # values of one bracket that are put in order in one row

#: Matrices (rows, columns) of a batch, a missing value as NaN; infinite values count as missing.
Read = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


@dataclass
class Stats:
    """Count, mean, sum of squared deviations and bounds of every column, and the sums of the caller's own counts."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    counts: np.ndarray

    @property
    def sd(self) -> np.ndarray:
        return np.where(self.n > 1, np.sqrt(self.m2 / np.maximum(self.n - 1, 1)), np.nan)


def slices(n: int, width: int) -> Iterator[slice]:
    """Cuts of ``n`` rows so that a matrix of ``width`` columns stays near 16 MB."""
    step = max(1, (1 << 21) // max(width, 1))
    for lo in range(0, n, step):
        yield slice(lo, min(lo + step, n))


def _merge(a: tuple, b: tuple) -> tuple:
    """Moments of two parts together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    d = b[1] - a[1]
    return n, a[1] + d * b[0] / some, a[2] + b[2] + d * d * a[0] * b[0] / some, np.fmin(a[3], b[3]), np.fmax(a[4], b[4])


def _empty(width: int) -> tuple:
    return np.zeros(width, dtype="int64"), np.zeros(width), np.zeros(width), np.full(width, np.nan), np.full(width, np.nan)


def array_stats(rows: DataFrame, read: Read, width: int, count: Callable[[np.ndarray], np.ndarray] | None = None, counts: int = 0) -> Stats:
    """One pass over ``rows``. ``count`` gives ``counts`` numbers of a matrix, which are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, own = _empty(width), np.zeros(counts)
        for batch in batches:
            for m in read(batch) if batch.num_rows else ():
                if count is not None:
                    own += count(m)
                gone = ~np.isfinite(m)
                if gone.any():
                    m = np.where(gone, np.nan, m)
                n = len(m) - gone.sum(axis=0)
                mean = np.where(gone, 0.0, m).sum(axis=0) / np.maximum(n, 1)
                dev = np.where(gone, 0.0, m - mean)
                acc = _merge(acc, (n, mean, (dev * dev).sum(axis=0), np.fmin.reduce(m, axis=0), np.fmax.reduce(m, axis=0)))
        n, mean, m2, lo, hi = acc
        one = lambda a, fill: pa.array(np.concatenate([a, fill]))
        zero = np.zeros(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + counts, dtype="int32")), one(n, zero.astype("int64")), one(mean, own), one(m2, zero), one(lo, zero), one(hi, zero)], ["id", "n", "mean", "m2", "lo", "hi"])

    fields = "id int, n long, mean double, m2 double, lo double, hi double"

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] >= width:  # a count of the caller's own, in the place of the mean
            return pd.DataFrame([(key[0], 0, pdf["mean"].sum(), 0.0, 0.0, 0.0)], columns=list(pdf.columns))
        acc = _empty(1)
        for r in pdf.itertuples(index=False):
            acc = _merge(acc, tuple(np.array([v]) for v in (r.n, r.mean, r.m2, r.lo, r.hi)))
        return pd.DataFrame([(key[0], *(a[0] for a in acc))], columns=list(pdf.columns))

    n, mean, m2, lo, hi = _empty(width)
    own = np.zeros(counts)
    for r in rows.mapInArrow(run, fields).groupBy("id").applyInPandas(together, fields).collect():  # one row a column
        if r.id >= width:
            own[r.id - width] = r.mean
        else:
            n[r.id], mean[r.id], m2[r.id] = r.n, r.mean, r.m2
            lo[r.id], hi[r.id] = (np.nan if v is None else v for v in (r.lo, r.hi))
    return Stats(n, mean, m2, lo, hi, own)


@dataclass
class _Bracket:
    """Values a to b of a column, ``before`` of its values below them, ``size`` among them, and the wanted places (from 0) among all its values."""

    column: int
    a: float
    b: float
    before: int
    size: int
    ranks: list[int]

    @property
    def scale(self) -> float:
        span = self.b - self.a
        return BINS / span if math.isfinite(span) and span > 0 else math.inf

    def edge(self, j: int) -> float:
        """The smallest number of interval ``j``: what :func:`_intervals` says of a number decides."""
        lo, hi = _code(self.a), _code(self.b)
        while lo < hi:  # 64 halvings at most
            mid = (lo + hi) // 2
            if int(_intervals(np.array([_number(mid)]), self.a, self.scale)[0]) >= j:
                hi = mid
            else:
                lo = mid + 1
        return _number(lo)


def _code(x: float) -> int:
    """Numbers as whole numbers in the same order, next to each other."""
    i = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return i if i >= 0 else -(i & 0x7FFFFFFFFFFFFFFF)


def _number(code: int) -> float:
    return struct.unpack("<d", struct.pack("<q", code))[0] if code >= 0 else -struct.unpack("<d", struct.pack("<q", -code))[0]


def _intervals(x: np.ndarray, a: float, scale: float) -> np.ndarray:
    """Interval of every value from ``a`` on; it never falls as the value rises."""
    return np.minimum((x - a) * scale, BINS - 1).astype(np.intp)


def _inside(m: np.ndarray, brackets: list[_Bracket]) -> Iterator[tuple[int, _Bracket, np.ndarray]]:
    wide = np.ascontiguousarray(m.T)
    for i, k in enumerate(brackets):
        x = wide[k.column]
        yield i, k, x[(x >= k.a) & (x <= k.b)]


def _cut(rows: DataFrame, read: Read, brackets: list[_Bracket]) -> list[_Bracket]:
    """The parts of ``brackets`` that hold their wanted places, by counts of all values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(brackets), BINS), dtype="int64")
        lo, hi = np.full(len(brackets), np.inf), np.full(len(brackets), -np.inf)
        for batch in batches:
            for m in read(batch) if batch.num_rows else ():
                for i, k, x in _inside(m, brackets):
                    if len(x):
                        seen[i] += np.bincount(_intervals(x, k.a, k.scale), minlength=BINS)
                        lo[i], hi[i] = min(lo[i], x.min()), max(hi[i], x.max())
        at, bin_ = np.nonzero(seen)
        some, starts = np.unique(at, return_index=True)
        offsets = pa.array(np.append(starts, len(at)).astype("int32"))
        lists = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("int32")), lists(bin_.astype("int32")), lists(seen[at, bin_]), pa.array(lo[some]), pa.array(hi[some])], ["i", "bins", "c", "lo", "hi"])

    def locate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = brackets[key[0]]
        total = np.bincount(np.concatenate(pdf["bins"].to_list()), weights=np.concatenate(pdf["c"].to_list()), minlength=BINS).astype("int64")
        ends = k.before + np.cumsum(total)
        j = np.searchsorted(ends, k.ranks, side="right")
        return pd.DataFrame({"i": key[0], "rank": k.ranks, "j": j, "before": ends[j] - total[j], "size": total[j], "lo": pdf["lo"].min(), "hi": pdf["hi"].max()})

    counted = rows.mapInArrow(run, "i int, bins array<int>, c array<long>, lo double, hi double")
    found = counted.groupBy("i").applyInPandas(locate, "i int, rank long, j int, before long, size long, lo double, hi double")
    parts: dict[tuple[int, int], _Bracket] = {}
    for r in found.collect():  # one row a wanted place
        k = brackets[r.i]
        if (r.i, r.j) not in parts:
            b = r.hi if r.j == BINS - 1 else min(r.hi, math.nextafter(k.edge(r.j + 1), -math.inf))
            parts[r.i, r.j] = _Bracket(k.column, max(r.lo, k.edge(r.j)), b, r.before, r.size, [])
        parts[r.i, r.j].ranks.append(r.rank)
    return list(parts.values())


def _picked(rows: DataFrame, read: Read, brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    """The wanted values of ``brackets``, each of which holds few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in brackets]
        for batch in batches:
            for m in read(batch) if batch.num_rows else ():
                for i, _, x in _inside(m, brackets):
                    if len(x):
                        kept[i].append(x)
        some = [i for i, parts in enumerate(kept) if parts]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.concatenate(kept[i]) for i in some], pa.list_(pa.float64()))], ["i", "x"])

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = brackets[key[0]]
        x = np.sort(np.concatenate(pdf["x"].to_list()))
        return pd.DataFrame({"i": key[0], "rank": k.ranks, "x": x[np.array(k.ranks) - k.before]})

    found = rows.mapInArrow(run, "i int, x array<double>").groupBy("i").applyInPandas(pick, "i int, rank long, x double")
    return {(brackets[r.i].column, r.rank): r.x for r in found.collect()}  # one row a wanted place


def array_quantiles(rows: DataFrame, read: Read, stats: Stats, probs: list[float], bound: int = BOUND) -> np.ndarray:
    """Exact type-7 quantiles (columns, probs) of every column, NaN for one without values.

    Each round counts the values of the brackets in equal intervals and goes on with those that hold a wanted place, whatever their number; a bracket of at
    most ``bound`` values is put in order, one of a single number needs no more. The counts decide, so ties and long tails cost rounds, not exactness.
    """
    place = lambda n, p: (n - 1) * p
    width = len(stats.n)
    open_: list[_Bracket] = []
    for c in range(width):
        n = int(stats.n[c])
        if n:
            below = {min(math.floor(place(n, p)), n - 1) for p in probs}
            open_.append(_Bracket(c, float(stats.lo[c]), float(stats.hi[c]), 0, n, sorted(below | {min(k + 1, n - 1) for k in below})))
    value: dict[tuple[int, int], float] = {}
    small: list[_Bracket] = []
    while open_:
        value |= {(k.column, rank): k.a for k in open_ if k.a == k.b for rank in k.ranks}
        left = [k for k in open_ if k.a < k.b]
        wide = [k for k in left if k.size > bound and math.isfinite(k.scale)]
        small += [k for k in left if not (k.size > bound and math.isfinite(k.scale))]
        open_ = _cut(rows, read, wide) if wide else []
    if small:
        value |= _picked(rows, read, small)
    out = np.full((width, len(probs)), np.nan)
    for c in range(width):
        n = int(stats.n[c])
        for i, p in enumerate(probs) if n else ():
            k = min(math.floor(place(n, p)), n - 1)
            a, b = value[c, k], value[c, min(k + 1, n - 1)]
            out[c, i] = a + (place(n, p) - k) * (b - a)
    return out
