"""Embedding whitening by cyclic Jacobi rotations.

Vectors become integers; the fit list is each distinct one once. Spark finds their number and exact sums,
then the scatter of the vectors less their mean, each task adding up its own matrix. The driver turns
that matrix by Jacobi rotations, sweep after sweep over all pairs, until every entry off the diagonal
vanishes against its two diagonal ones, which keeps small eigenvalues accurate as well. The unit
eigenvectors of the largest eigenvalues, each over the root of its eigenvalue, are the whitening matrix,
which is broadcast.

The driver sees sums and one matrix of the vector's length squared, whatever the number of rows. One
shuffle moves vectors: that of the distinct ones, after tasks have folded their own.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are
vectors shorter than the table's longest one; entries are held within 2**31 (8,388,608 before they
become integers); repeated rows count once in the fit and each get rows of their own; vectors of fewer
entries than ``COMPONENTS`` have as many components as entries; a component along which the fit list does
not vary (an eigenvalue of at most ``FLAT`` of the largest) has a null ``whitened`` and is left out
of ``identity_error``, which is 0 if none is left; without any variance ``explained`` is null; a ``deviation``
beyond a long is null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidoc.llm.common import cut
from evidoc.llm.vectors import integers, length, matrices, usable

COMPONENTS = 4
LIMIT = 1 << 31
#: Share of the largest eigenvalue that rounding alone may leave in one.
FLAT = 1e-13
LONG = (1 << 63) - 1
#: Numbers of a matrix's row that travel as one row.
BLOCK = 64


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a = np.array(matrix, dtype=np.float64)
    size = len(a)
    v = np.eye(size)
    for _ in range(sweeps):
        turned = False
        for p in range(size - 1):
            for q in range(p + 1, size):
                off = a[p, q]
                if off == 0 or abs(off) <= 2.0**-53 * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                pp, qq = a[p, p] - t * off, a[q, q] + t * off
                for m in (a.T, v.T):  # columns p and q of a and of v
                    x, y = m[p].copy(), m[q].copy()
                    m[p], m[q] = c * x - s * y, s * x + c * y
                x, y = a[p].copy(), a[q].copy()
                a[p], a[q] = c * x - s * y, s * x + c * y
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0.0, 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """What is known of a fit list: its size, sums, and components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray  # a column each
    trace: float

    @property
    def varied(self) -> np.ndarray:
        return self.values > FLAT * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, dtype=bool)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers along each component that varies; others are left at 0."""
        scale = np.where(self.varied, 1 / np.sqrt(np.where(self.varied, self.values, 1)), 0)
        return self.centred(x) @ (self.vectors * scale)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - sums) ** 2 of each row, exact; None beyond a long."""
        most = max(self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0), 1)
        kind = np.int64 if most * most * x.shape[1] <= LONG else object  # Python's whole numbers where longs may not do
        d = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(v) if v <= LONG else None for v in (d * d).sum(axis=1).tolist()]


def added(rows: DataFrame, width: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The matrix that ``make`` makes of a matrix of rows, added up over all rows (column ``x``). A task
    gives a row for ``BLOCK`` numbers."""

    def run(batches):
        total = None
        for b in batches:
            for _, x in matrices(b.column(0), width):
                own = make(x)
                total = own if total is None else total + own
        if total is not None:
            at = [(i, j) for i in range(total.shape[0]) for j in range(0, total.shape[1], BLOCK)]
            v = [total[i, j : j + BLOCK].tolist() for i, j in at]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*at, strict=True)), pa.array(v, pa.list_(pa.float64()))], names=["i", "j", "v"])

    each = [F.sum(F.get("v", k)).alias(f"v{k}") for k in range(min(BLOCK, width))]
    made = rows.select("x").mapInArrow(run, "i long, j long, v array<double>").groupBy("i", "j").agg(*each).collect()
    out = {(r["i"], r["j"] + k): r[f"v{k}"] for r in made for k in range(len(each)) if r[f"v{k}"] is not None}
    full = np.zeros(tuple(1 + max(c) for c in zip(*out, strict=True)))
    for at, v in out.items():
        full[at] = v
    return full


def totals(rows: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sums by position."""

    def run(batches):
        n, total = 0, np.zeros(width, dtype=np.int64)
        for b in batches:
            for _, x in matrices(b.column(0), width):
                n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)]), pa.array([n, *total.tolist()], pa.int64())], names=["at", "v"])

    made = rows.select("x").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    got = {r["at"]: int(r["v"]) for r in made}
    return got.get(-1, 0), tuple(got.get(k, 0) for k in range(width))


def learn(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a fit list (column ``x``)."""
    n, sums = totals(fit, width)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    mean = np.array([s / n for s in sums])

    def scatter(x: np.ndarray) -> np.ndarray:
        d = x - mean
        return d.T @ d

    values, vectors = jacobi(added(fit, width, scatter) / n)
    return Whitening(n, sums, values[:components], vectors[:, :components], float(values.sum()))


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, at most, in any entry."""
    own = model.varied
    if not own.any():
        return 0.0
    shared = fit.sparkSession.sparkContext.broadcast(model)
    mean = added(fit, width, lambda x: shared.value.whitened(x)[:, own].sum(axis=0, keepdims=True))[0] / model.n

    def scatter(x: np.ndarray) -> np.ndarray:
        d = shared.value.whitened(x)[:, own] - mean
        return d.T @ d

    error = np.abs(added(fit, width, scatter) / model.n - np.eye(int(own.sum()))).max()
    shared.destroy()
    return float(error)


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    src = embeddings.select("vec_id", "embedding")
    width = length(src)
    rows = integers(src.filter(usable() & (F.size("embedding") == width)), ["vec_id"], LIMIT)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {SCHEMA}"
    if not width:
        return src.sparkSession.createDataFrame([], schema)
    fit = cut(rows.select("x").distinct())
    model = learn(fit, width, components)
    error = identity_error(fit, width, model)
    shared = src.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        k = len(own.values)
        share = [float(v / own.trace) if own.trace > 0 else None for v in own.values]
        for b in batches:
            for lo, x in matrices(b.column(1), width):
                size = len(x)
                made = own.whitened(x).ravel()
                off = np.tile(~own.varied, size)
                cols = [
                    b.column(0).slice(lo, size).take(pa.array(np.repeat(np.arange(size), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, own.n)),
                    pa.array(own.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(size), k))),
                    pa.array(made, mask=off),
                    pa.array(share * size, pa.float64()),
                    pa.array(np.full(size * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", *(f.split()[0] for f in SCHEMA.split(", "))])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
