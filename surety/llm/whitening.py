"""Embedding whitening with a covariance by polarisation.

With y = n*x - S, the centred vector times n, four passes over the table, each of them one map whose tasks hand on totals:

1. n and the sums S of every dimension;
2. for every dimension i the exact sum of y_i^2, for every pair i < j the exact sum of (y_i + y_j)^2. As
   (y_i + y_j)^2 - y_i^2 - y_j^2 = 2 y_i y_j, differences of these variances give all cross-covariances without rounding;
3. the covariance of the whitened rows, for the error against the identity;
4. the whitened rows.

All of 1 and 2 is done in whole numbers: squares are split into limbs of 24 bits so that 64-bit sums hold them, and a task
hands on limbs of 60 bits that Spark adds up as decimals. What reaches the driver is one number per pair of dimensions, the
matrix `eigh` needs in one place; its size does not depend on the rows. The source is read four times: hand in a stored
table. No row is moved between tasks, so no value can become a hot key.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS = 1024                 # rows squared at a time: 1024 products of two 26-bit limbs stay under 2^62
BITS = 24
LIMB = 60
FARTHEST = float(1 << 46)   # values beyond are set to it (a component over 6e10)
LEAST = 1e-10               # an eigenvalue under this share of the greatest cannot be told from zero to four places

_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
        "deviation_exact decimal(38,0)")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows whose vector is there and holds finite numbers only."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))


def quantised(embedding: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and x-vectors of each length of vector, at most `ROWS` at a time."""
    sizes = embedding.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = embedding.flatten().to_numpy(zero_copy_only=False)
    x = np.clip(np.floor(SCALE * flat), -FARTHEST, FARTHEST).astype(np.int64) + SHIFT
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        if dim:
            own = np.flatnonzero(sizes == dim)
            for rows in np.split(own, range(ROWS, len(own), ROWS)):
                yield rows, x[starts[rows][:, None] + np.arange(dim)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, in 64 bits where sums of two of them have under 50 bits, else in Python's numbers."""
    if n * (int(np.abs(x).max()) + 1) < 1 << 61:
        y = n * x - sums.astype(np.int64)
        if int(np.abs(y).max()) < 1 << 49:
            return y
    return n * x.astype(object) - sums


def _squares(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over rows of the limbs' products: z^2 = a^2 2^48 + 2ab 2^24 + b^2."""
    a, b = z >> BITS, z & ((1 << BITS) - 1)
    return (a * a).sum(0), (a * b).sum(0), (b * b).sum(0)


class PairTotals:
    """Exact sums of y_i^2 (on the diagonal) and (y_i + y_j)^2 over the rows added."""

    def __init__(self, dim: int):
        self.dim = dim
        self.low, self.high = np.zeros((3, dim, dim), np.int64), np.zeros((3, dim, dim), np.int64)
        self.wide = None

    def add(self, y: np.ndarray) -> None:
        wide = y.dtype == object
        if wide and self.wide is None:
            self.wide = np.zeros((self.dim, self.dim), object)
        for i in range(self.dim):
            z = y[:, i:] + y[:, i:i + 1]
            z[:, 0] = y[:, i]
            if wide:
                self.wide[i, i:] += (z * z).sum(0)
            else:
                for k, part in enumerate(_squares(z)):
                    self.low[k, i, i:] += part & 0xFFFFFFFF
                    self.high[k, i, i:] += part >> 32

    def total(self, i: int, j: int) -> int:
        parts = [(int(self.high[k, i, j]) << 32) + int(self.low[k, i, j]) for k in range(3)]
        known = (parts[0] << 2 * BITS) + (parts[1] << BITS + 1) + parts[2]
        return known if self.wide is None else known + int(self.wide[i, j])


def _limbs(rows: Iterator[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """dim, i, j, limb, part of totals that may be longer than any column; the part of the last limb keeps the sign."""
    out = []
    for dim, i, j, total in rows:
        for limb in range(3):
            part = total if limb == 2 else total & ((1 << LIMB) - 1)
            if part:
                out.append((dim, i, j, limb, Decimal(part)))
            total = (total - part) >> LIMB if limb < 2 else 0
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)],
                                      ["dim", "i", "j", "limb", "part"])


_PARTS = "dim int, i int, j int, limb int, part decimal(38,0)"


def _added(rows: DataFrame, partial: Callable) -> dict[tuple[int, int, int], int]:
    """The totals by (dim, i, j), added up over all tasks."""
    parts = rows.select("embedding").mapInArrow(partial, _PARTS).groupBy("dim", "i", "j", "limb").agg(F.sum("part").alias("part"))
    found: dict[tuple[int, int, int], int] = defaultdict(int)
    for r in parts.collect():   # one number per pair of dimensions
        found[r["dim"], r["i"], r["j"]] += int(r["part"]) << LIMB * r["limb"]
    return found


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = defaultdict(int), {}
    for batch in batches:
        for rows, x in quantised(batch.column("embedding")):
            dim = x.shape[1]
            n[dim] += len(rows)
            sums[dim] = sums.get(dim, 0) + x.sum(0).astype(object)
    # column -1 holds the number of rows
    yield _limbs((dim, i, i, total) for dim, s in sums.items() for i, total in [(-1, n[dim]), *enumerate(s.tolist())])


def _square_rows(sums: dict[int, tuple[int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, PairTotals] = {}
        for batch in batches:
            for _, x in quantised(batch.column("embedding")):
                dim = x.shape[1]
                totals.setdefault(dim, PairTotals(dim)).add(centred(x, *sums[dim]))
        yield _limbs((dim, i, j, t.total(i, j)) for dim, t in totals.items() for i in range(dim) for j in range(i, dim))
    return run


@dataclass(frozen=True)
class Model:
    """What whitens the vectors of one length."""

    n: int
    sums: np.ndarray            # of x, whole numbers
    covariance: np.ndarray
    values: np.ndarray          # eigenvalues, falling
    components: np.ndarray      # dim x k, unit columns
    kept: int                   # components with an eigenvalue above zero
    error: float = float("nan")

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows of y = n*x - S on the components with variance."""
        return (y.astype(np.float64) / self.n) @ (self.components[:, :self.kept] / np.sqrt(self.values[:self.kept]))


def covariances(totals: dict[tuple[int, int, int], int], dim: int, n: int) -> np.ndarray:
    """The covariance matrix by polarisation: rounded once, at the end."""
    v = np.empty((dim, dim))
    for i in range(dim):
        own = totals.get((dim, i, i), 0)
        v[i, i] = own / n ** 3
        for j in range(i + 1, dim):
            v[i, j] = v[j, i] = (totals.get((dim, i, j), 0) - own - totals.get((dim, j, j), 0)) / (2 * n ** 3)
    return v


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """One model per length of vector found; no usable row, no model."""
    rows = usable(vectors)
    found = _added(rows, _sum_rows)
    sums = {dim: (found[dim, -1, -1], np.array([found.get((dim, i, i), 0) for i in range(dim)], object))
            for dim in sorted({d for d, i, _ in found if i == -1})}
    totals = _added(rows, _square_rows(sums)) if sums else {}
    models = {}
    for dim, (n, s) in sums.items():
        v = covariances(totals, dim, n)
        values, columns = np.linalg.eigh(v)
        values, columns = np.maximum(values[::-1][:components], 0), columns[:, ::-1][:, :components]
        models[dim] = Model(n, s, v, values, columns, int((values > LEAST * values[0]).sum()))
    return _with_error(rows, models)


def _whitened_moments(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in quantised(batch.column("embedding")):
                dim = x.shape[1]
                w = models[dim].project(centred(x, models[dim].n, models[dim].sums))
                w = np.c_[np.ones(len(w)), w]
                sums[dim] = sums.get(dim, 0) + w.T @ w
        rows = [(dim, i, j, float(m[i, j])) for dim, m in sums.items() for i in range(len(m)) for j in range(i, len(m))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))],
            ["dim", "i", "j", "part"])
    return run


def _with_error(rows: DataFrame, models: dict[int, Model]) -> dict[int, Model]:
    """Models with the largest absolute entry of the whitened rows' covariance minus the identity."""
    if not models:
        return models
    parts = rows.select("embedding").mapInArrow(_whitened_moments(models), "dim int, i int, j int, part double")
    sums = {(r["dim"], r["i"], r["j"]): r["part"] for r in parts.groupBy("dim", "i", "j").agg(F.sum("part").alias("part")).collect()}
    out = {}
    for dim, m in models.items():
        mean = np.array([sums[dim, 0, i + 1] / m.n for i in range(m.kept)])
        gaps = [abs(sums[dim, i + 1, j + 1] / m.n - mean[i] * mean[j] - (i == j)) for i in range(m.kept) for j in range(i, m.kept)]
        out[dim] = Model(m.n, m.sums, m.covariance, m.values, m.components, m.kept, max(gaps, default=0.0))
    return out


def _deviations(y: np.ndarray) -> list[int]:
    if y.dtype == object:
        return [sum(v * v for v in row) for row in y.tolist()]
    aa, ab, bb = _squares(y.T)
    return [(p << 2 * BITS) + (q << BITS + 1) + r for p, q, r in zip(aa.tolist(), ab.tolist(), bb.tolist())]


def _whiten(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for rows, x in quantised(batch.column("embedding")):
                m = models[x.shape[1]]
                k, y = len(m.values), centred(x, m.n, m.sums)
                w = np.full((len(y), k), np.nan)
                w[:, :m.kept] = m.project(y)
                trace = float(np.trace(m.covariance))
                explained = m.values / trace if trace > 0 else np.full(k, np.nan)
                exact = [d for d in _deviations(y) for _ in range(k)]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                    pa.array(np.full(len(y) * k, m.n, np.int64)), pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(explained, len(y)), from_pandas=True),
                    pa.array(np.full(len(y) * k, m.error)),
                    pa.array([Decimal(d) if d < 10 ** 38 else None for d in exact], pa.decimal128(38, 0)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])
    return run


def whiten(vectors: DataFrame, models: dict[int, Model] | None = None) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact.

    A row per usable vector and component. Vectors that are null or hold a null or non-finite number are left out; an empty
    vector has no dimension and so no row; vectors of another length are fitted among themselves. A null or repeated vec_id
    keeps its rows, and copies count each. A component without variance (one row, equal rows, fewer rows than dimensions)
    has a null `whitened` and takes no part in the error; `explained` is null where nothing varies. `deviation` is null
    where it needs more than 64 bits: `deviation_exact` then still holds it. An empty table gives no rows. Other columns of
    the table are not read.
    """
    return usable(vectors).mapInArrow(_whiten(fit(vectors) if models is None else models), _OUT)
