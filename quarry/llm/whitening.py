"""Whitening of embeddings: principal components of a distributed scatter, by cyclic Jacobi.

Vectors become whole numbers (``vectors``), and the fit list holds each distinct one once. Three
passes over that list run on the executors and send sums only: the number of vectors n and the sums
S of each dimension, exactly; the scatter of x - S/n, centred before anything is multiplied; and, with
the fit at hand, the covariance of the whitened list, whose distance from the identity is reported. The
driver holds one matrix of dimension by dimension, whatever the rows, and turns it by symmetric
Jacobi rotations, sweep by sweep, until every off-diagonal entry is below rounding against its own two
diagonal entries; this keeps small eigenvalues accurate. Eigenvalues fall; a component's sign makes its
largest entry positive. The components and S are broadcast, and each row is whitened where it is.

Defined cases: vectors of each length are fitted among themselves, so that the driver holds a matrix for
each length that occurs; an empty vector has no component; a vector that is null or holds a null or
non-finite component is dropped; a component of a bound of rounding times the greatest eigenvalue or
less counts as 0: it whitens to 0.0 and is left out of ``identity_error``, which is 0.0 if none is
left; ``explained`` is 0.0 where all variance is; ``deviation`` is null beyond a long; a null id stays null;
rows that repeat, or share an id, each give their rows; other columns are ignored; an empty table gives no
rows. The driver's work grows with the cube of the dimension, never with the rows.
"""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vectors
from quarry.scratch import materialize, passing

EPS = float(np.finfo(float).eps)
SWEEPS = 60
#: Vectors that are multiplied at once.
SLAB = 4096
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a, n = np.array(matrix, float), len(matrix)
    v, floor = np.eye(n), 1e-30 * float(np.abs(np.diag(matrix)).sum())
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if abs(off) <= max(floor, EPS * math.sqrt(abs(a[p, p] * a[q, q]))):
                    continue
                turned = True
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = math.copysign(1, half) / (abs(half) + math.hypot(1, half))
                c = 1 / math.hypot(1, t)
                s = t * c
                low, high = a[p, p] - t * off, a[q, q] + t * off
                one, two = a[p].copy(), a[q].copy()
                a[p], a[q] = c * one - s * two, s * one + c * two
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
                one = v[:, p].copy()
                v[:, p], v[:, q] = c * one - s * v[:, q], s * one + c * v[:, q]
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order] / np.sqrt(np.square(v[:, order]).sum(0))
    signs = np.sign(v[np.abs(v).argmax(0), np.arange(n)]) if n else np.ones(0)
    return values[order], v * np.where(signs == 0, 1, signs)


@dataclass
class Fit:
    """n vectors with sums S, eigenvalues of all components, and the eigenvectors of those asked for."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    error: float = 0.0

    def __post_init__(self) -> None:
        self.mean = np.array([s / self.n for s in self.sums])
        least = len(self.sums) * EPS * max(0.0, float(self.values[0]) if len(self.values) else 0.0)
        kept = self.values[: self.components.shape[1]]
        self.real = kept > least
        self.scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, kept, 1)), 0.0)
        trace = float(self.values.sum())
        self.explained = np.where(self.real, kept, 0) / trace if trace > 0 else np.zeros(len(kept))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.components) * self.scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)**2, exactly; None beyond a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if x.shape[1] * most * most < 1 << 63:
            return np.square(self.n * x - np.array(self.sums, np.int64)).sum(1).tolist()
        exact = (sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [d if d < 1 << 63 else None for d in exact]


def _packed(batches):
    for batch in batches:
        fit, packed = vectors.pack(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fit)), packed], ["vec_id", "packed"])


def _summed(of):
    """A task's sums by length: ``of(length, x)`` gives, for a matrix of some vectors, an array that adds up."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, (_, x) in vectors.unpack(batch.column(0).to_pylist()).items():
                for k in range(0, len(x), SLAB):
                    got = of(length, x[k : k + SLAB])
                    held[length] = held[length] + got if length in held else got
        yield from held.items()

    return run


def _counts(batches):
    add = lambda length, x: np.array([len(x), *(x.sum(0) if np.abs(x).max(initial=0) * len(x) < 1 << 62 else x.astype(object).sum(0))], object)
    for length, sums in _summed(add)(batches):
        yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([[Decimal(int(v)) for v in sums]], pa.list_(pa.decimal128(38, 0)))], ["length", "sums"])


def _added(parts: DataFrame, value: str) -> DataFrame:
    """(length, at, total): arrays of (length, sums) added up place by place, no array in one task."""
    return parts.select("length", F.posexplode("sums").alias("at", "v")).groupBy("length", "at").agg(F.sum("v").cast(value).alias("total"))


def _matrices(listed: DataFrame, of) -> dict[int, np.ndarray]:
    """By length the sum of the square matrices that ``of`` gives."""

    def run(batches):
        for length, m in _summed(of)(batches):
            yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([m.reshape(-1).tolist()], pa.list_(pa.float64()))], ["length", "sums"])

    out: dict[int, dict[int, float]] = {}
    for r in _added(listed.mapInArrow(run, "length int, sums array<double>"), "double").collect():  # the squares of the lengths that occur
        out.setdefault(r["length"], {})[r["at"]] = r["total"]
    return {length: np.array([m[k] for k in range(len(m))]).reshape(math.isqrt(len(m)), -1) for length, m in out.items()}


def fit(listed: DataFrame, components: int = 4) -> dict[int, Fit]:
    """The fit of each length of the distinct vectors ``listed`` (packed)."""
    spark = listed.sparkSession
    sums: dict[int, dict[int, int]] = {}
    for r in _added(listed.mapInArrow(_counts, "length int, sums array<decimal(38,0)>"), "decimal(38,0)").collect():
        sums.setdefault(r["length"], {})[r["at"]] = int(r["total"])
    plain = {length: (s[0], [s[k] for k in range(1, length + 1)]) for length, s in sums.items() if length}
    means = spark.sparkContext.broadcast({length: np.array([s / n for s in all_]) for length, (n, all_) in plain.items()})

    def scatter(length, x):
        centred = x - means.value.get(length, np.zeros(length))
        return centred.T @ centred

    fits = {}
    for length, m in _matrices(listed.where(F.octet_length("packed") > 1), scatter).items():
        n, all_ = plain[length]
        values, v = jacobi((m + m.T) / (2 * n))
        fits[length] = Fit(n, all_, np.maximum(values, 0), v[:, :components])
    shared = spark.sparkContext.broadcast({k: astuple(f) for k, f in fits.items()})

    def spread(length, x):
        w = Fit(*shared.value[length]).whiten(x)
        return w.T @ w

    for length, m in _matrices(listed.where(F.octet_length("packed") > 1), spread).items():
        real = fits[length].real
        off = np.abs(m / fits[length].n - np.eye(len(m)))[real][:, real]
        fits[length].error = float(off.max(initial=0))
    return fits


def whiten(rows: DataFrame, components: int = 4) -> DataFrame:
    """For every row of ``rows`` (vec_id, embedding) that takes part, its first ``components``
    whitened components: the columns of RESULT. See the module."""
    spark = rows.sparkSession
    packed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_packed, "vec_id long, packed binary")
    with passing(spark):
        listed = materialize(packed.select("packed").distinct())
        shared = spark.sparkContext.broadcast({k: astuple(f) for k, f in fit(listed, components).items()})

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for length, (places, x) in vectors.unpack(batch.column(1).to_pylist()).items():
                if not length:
                    continue
                own = Fit(*shared.value[length])
                k, rows = own.components.shape[1], len(x)
                each = lambda values, kind: pa.array([v for v in values for _ in range(k)], kind)
                yield pa.RecordBatch.from_arrays(
                    [each((ids[p] for p in places.tolist()), pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, own.n)), each(own.deviation(x), pa.int64()),
                     pa.array(own.whiten(x).reshape(-1)), pa.array(np.tile(own.explained, rows)), pa.array(np.full(rows * k, own.error))], [c.split()[0] for c in RESULT.split(", ")])

    return packed.mapInArrow(run, RESULT)
