"""Operator 11: whitening from an exact integer scatter.

Vectors become fixed-point integers x. A shift is subtracted, and sums and cross-products of what is left are accumulated without
rounding: numpy multiplies limbs of 20 bits in blocks whose sums stay below 2**53, tasks add them as Python integers,
and Spark adds limbs of 32 bits as longs. The driver gets one total for each pair of dimensions, however many vectors
there are, and forms n * sum(x x') - S S' exactly (the shift drops out). Only that matrix becomes floating point,
over n squared, and ``numpy.linalg.eigh`` decomposes it.

Nulls and odd rows: a vector that is null or empty, or holds a null or an entry that is not finite, takes no part; nor does one
that is not of the most frequent length (of the shortest such, at a tie). Entries beyond 2**62 after scaling count as that. Repeated rows are
rows of their own; a null vec_id is kept. A component without variance has null ``whitened``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, OFFSET = 64, 1_000_000
#: Bits of a limb in products, rows whose products of limbs are summed as floats (2 * LIMB bits and these stay under 53), and bits of a limb between tasks.
LIMB, ROWS, PASSED = 20, 4096, 32
_FAR = 2**62


@dataclass
class Whitening:
    """A fitted model: components are the rows of ``directions``, by falling eigenvalue."""

    n: int
    sums: np.ndarray  # of shifted fixed-point entries, Python integers
    values: np.ndarray
    directions: np.ndarray
    trace: float
    scale: int
    offset: int

    @property
    def varied(self) -> np.ndarray:
        """Which components have variance, by eigh's accuracy."""
        return self.values > (self.values.max(initial=0.0) * len(self.sums) * 2.0**-52)

    @property
    def explained(self) -> list[float | None]:
        return [float(e) / self.trace if self.trace > 0 else None for e in self.values]


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as array<double>."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = materialize(vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0").where(finite))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def shifted(values: np.ndarray, scale: int) -> np.ndarray:
    """Fixed-point entries less the shift, which is the offset: floor(scale * c)."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * scale), -_FAR, _FAR).astype(np.int64)


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Floats l0, l1, ... with y = l0 + l1 * 2**LIMB + ...; only the last has signs."""
    found = []
    while np.abs(y).max(initial=0) >= 1 << LIMB:
        found.append((y & ((1 << LIMB) - 1)).astype(float))
        y = y >> LIMB
    return [*found, y.astype(float)]


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the rows of y (longs), as arrays of Python integers."""
    sums, products = np.zeros(y.shape[1], object), np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), ROWS):
        limbs = _limbs(y[at : at + ROWS])
        for i, a in enumerate(limbs):
            sums += a.sum(axis=0).astype(np.int64).astype(object) << LIMB * i
            for j, b in enumerate(limbs):
                products += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return sums, products


def _passed(totals: dict[tuple[int, int], int]) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, place, limb) with each total the sum of limb * 2 ** (PASSED * place)."""
    for (i, j), value in totals.items():
        sign, value, place = (-1 if value < 0 else 1), abs(value), 0
        while value:
            if part := value & ((1 << PASSED) - 1):
                yield i, j, place, sign * part
            value, place = value >> PASSED, place + 1


def totals(rows: DataFrame, scale: int = SCALE) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, cross-products) of all shifted vectors; as many rows come to the driver as there are pairs of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                s, p = scatter(shifted(_matrix(batch, 0), scale))
                n, sums, products = n + batch.num_rows, sums + s, products + p
        if n:
            found = {(-1, -1): n} | {(-1, i): int(s) for i, s in enumerate(sums)}
            found |= {(i, j): int(products[i, j]) for i in range(len(sums)) for j in range(i, len(sums))}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_passed(found), strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "place", "limb"])

    summed = rows.select("v").mapInArrow(run, "i int, j int, place int, limb long").groupBy("i", "j", "place").agg(F.sum("limb").alias("limb")).collect()
    found: dict[tuple[int, int], int] = {}
    for r in summed:
        found[r.i, r.j] = found.get((r.i, r.j), 0) + (r.limb << PASSED * r.place)
    d = len(rows.select("v").first()["v"]) if found else 0
    sums = np.array([found.get((-1, i), 0) for i in range(d)], object)
    products = np.array([[found.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)], object).reshape(d, d)
    return found.get((-1, -1), 0), sums, products


def fit(rows: DataFrame, components: int = 32, scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The model of all ``rows`` (vec_id, v); None if there are none."""
    n, sums, products = totals(rows, scale)
    if not n:
        return None
    exact = n * products - np.outer(sums, sums)
    covariance = np.array([[int(x) / n**2 for x in row] for row in exact])  # Python divides integers with one rounding
    values, vectors = np.linalg.eigh(covariance)
    values, directions = values[::-1][:components], vectors.T[::-1][:components]
    signs = np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(axis=1)])
    return Whitening(n, sums, values, directions * signs[:, None], int(np.trace(exact)) / n**2, scale, offset)


def projected(y: np.ndarray, model: Whitening) -> tuple[list[int], np.ndarray]:
    """Of shifted rows: the exact sum of (n x - S)**2, and the whitened components (NaN without variance)."""
    far = max(int(np.abs(y).max(initial=0)) * model.n, *map(abs, model.sums.tolist()))
    sums = model.sums if far >= _FAR // 2 else model.sums.astype(np.int64)
    z = (y.astype(object) if far >= _FAR // 2 else y) * model.n - sums
    small = len(model.sums) * (2 * far) ** 2 < _FAR
    deviation = ((z if small else z.astype(object)) ** 2).sum(axis=1).tolist()
    spread = np.sqrt(np.where(model.varied, model.values, np.nan))
    return deviation, (z / model.n).astype(float) @ model.directions.T / spread


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of ``rows`` (vec_id, v): deviation is exact, whitened has one entry for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, w = projected(shifted(_matrix(batch, 1), model.scale), model)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(w.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def _moments(batches: Iterator[pa.RecordBatch], keep: np.ndarray, mean: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        w = _matrix(batch, 0)[:, keep]
        total = total + (w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean))
    if np.ndim(total):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(np.ravel(total))], ["k", "s"])


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` less the identity, as measured on its rows; None without variance."""
    keep = model.varied
    d, mean = int(keep.sum()), None
    if not d:
        return None
    for size in (d, d * d):
        found = whitened.select("whitened").mapInArrow(partial(_moments, keep=keep, mean=mean), "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        mean = np.zeros(size)
        for r in found:
            mean[r.k] = r.s / model.n
    return float(np.abs(mean.reshape(d, d) - np.eye(d)).max())


def whitened_components(vectors: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors`` (vec_id, embedding)."""
    rows = clean(vectors)
    model = fit(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    done = materialize(whiten(rows, model))
    share = F.array(*[F.lit(e).cast("double") for e in model.explained])
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("_k") + 1).alias("explained"), F.lit(identity_error(done, model)).cast("double").alias("identity_error"),
    )
