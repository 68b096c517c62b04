"""PCA whitening of embeddings from merged moments.

Each partition computes count, mean and centred scatter of its vectors, batch by batch; pairs of such moments are merged
by Chan's formula, within a task and then over tasks in a treeReduce, so what reaches the driver is one d x d matrix. The
eigenvectors of the covariance are found there (d is the width of a vector). A second pass whitens every vector and merges
the moments of the result, which must be those of an identity; a third gives the rows.

Entries are taken as integers, x = floor(1024 c) + 100000. Sums are exact integers, so the centre S / n is right to the
last bit and large offsets cost no digits.

Defined results: vectors that are null, hold null or non-finite entries or ones of 2^52 and more, or have another length
than the commonest one (of equally common ones the greater) are left out; repeated rows count and are given each; a null
vec_id stays null; a component without variance (fewer vectors than dimensions, equal entries) has a null `whitened` and no
part in identity_error; an empty table, or one of empty vectors, gives an empty result; other columns are unread.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
#: Entries from here on make no long.
_MOST = 2.0**52
#: Rows that are worked on at once.
_STEP = 4096


@dataclass
class Moments:
    """Of some vectors: how many, their mean, the sum of (v - mean)(v - mean)', and for integers their exact sums."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int] | None = None

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the moments of both sets of vectors."""
        if not self.n or not other.n:
            return self if self.n else other
        n, away = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(away, away) * (self.n / n * other.n)
        if self.sums is None or other.sums is None:
            return Moments(n, self.mean + away * (other.n / n), scatter)
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return Moments(n, _mean(sums, n), scatter, sums)


def _mean(sums: list[int], n: int) -> np.ndarray:
    return np.array([s / n for s in sums], float)  # of Python's integers: rounded once


def nothing(width: int) -> Moments:
    return Moments(0, np.zeros(width), np.zeros((width, width)))


def exact_sums(x: np.ndarray) -> list[int]:
    if x.size and float(np.abs(x).max()) * len(x) >= 2.0**62:
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def times_less(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs where these can hold them, else as Python's integers."""
    most = max([float(np.abs(x).max(initial=0)) * n, *(abs(float(s)) for s in sums)])
    return n * x - np.array(sums, np.int64) if most < 2.0**61 else n * x.astype(object) - np.array(sums, object)


def squares(away: np.ndarray) -> list[int]:
    """The exact sum of each row's squares."""
    if away.dtype == object or float(np.abs(away).max(initial=0)) ** 2 * away.shape[1] >= 2.0**62:
        away = away.astype(object)
    return [int(s) for s in (away * away).sum(axis=1)]


def of_integers(x: np.ndarray) -> Moments:
    if not len(x):
        return nothing(x.shape[1])
    sums = exact_sums(x)
    centred = (times_less(x, len(x), sums) / len(x)).astype(float)
    return Moments(len(x), _mean(sums, len(x)), centred.T @ centred, sums)


def of_doubles(z: np.ndarray) -> Moments:
    if not len(z):
        return nothing(z.shape[1])
    mean = z.mean(axis=0)
    return Moments(len(z), mean, (z - mean).T @ (z - mean))


def integer_vectors(batch: pa.RecordBatch, width: int):
    """The usable rows of (id, vector) batches in steps: their ids and x."""
    for k in range(0, batch.num_rows, _STEP):
        part = batch.slice(k, _STEP)
        part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column(1)), width), False))
        c = pc.cast(part.column(1).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # nulls become NaN
        fine = (np.abs(c) < _MOST).all(axis=1)
        yield part.column(0).filter(pa.array(fine)), np.floor(SCALE * c[fine]).astype(np.int64) + OFFSET


def merged_moments(rows: DataFrame, width: int, of_batch) -> Moments:
    """of_batch: batch -> Moments of its vectors, merged in each task, then pairwise over the tasks."""

    def run(batches):
        held = nothing(width)
        for b in batches:
            held = held.merged(of_batch(b))
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(held)], pa.binary())], ["held"])

    parts = rows.mapInArrow(run, "held binary").rdd.map(lambda r: cloudpickle.loads(bytes(r[0])))
    return parts.treeReduce(Moments.merged) if parts.getNumPartitions() else nothing(width)


def _all_of(vectors: DataFrame, width: int) -> Moments:
    def of_batch(batch):
        held = nothing(width)
        for _, x in integer_vectors(batch, width):
            held = held.merged(of_integers(x))
        return held

    return merged_moments(vectors, width, of_batch)


@dataclass
class Whitening:
    """What maps a vector to its components: centre (sums / n), directions (a column each), eigenvalues, their trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float

    @staticmethod
    def of(held: Moments, components: int) -> Whitening:
        covariance = held.scatter / held.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        k = min(components, len(values))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        least = len(covariance) * np.finfo(float).eps * max(values[0], 0.0)
        values = np.where(values > least, values, 0.0)
        sign = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)  # the largest entry is positive
        return Whitening(held.n, held.sums, vectors * sign, values, float(np.trace(covariance)))

    def apply(self, away: np.ndarray) -> np.ndarray:
        """away: n * x - sums. Components without variance give NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (away / self.n).astype(float) @ self.directions / np.where(self.values > 0, np.sqrt(self.values), np.nan)


def fit(vectors: DataFrame, width: int, components: int) -> Whitening | None:
    held = _all_of(vectors, width)
    return Whitening.of(held, components) if held.n else None


def identity_error(vectors: DataFrame, width: int, fitted: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, over components with variance."""
    there = np.flatnonzero(fitted.values > 0)
    if not len(there):
        return 0.0

    def of_batch(batch):
        held = nothing(len(there))
        for _, x in integer_vectors(batch, width):
            held = held.merged(of_doubles(fitted.apply(times_less(x, fitted.n, fitted.sums))[:, there]))
        return held

    found = merged_moments(vectors, len(there), of_batch)
    return float(np.abs(found.scatter / found.n - np.eye(len(there))).max())


def whiten(table: DataFrame, components: int = 8, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation (exact, decimal; null beyond 38 digits), whitened, explained and
    identity_error of each usable row and component."""
    vectors = table.select(F.col(name).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    kind = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    common = vectors.where("vector is not null").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    fitted = fit(vectors, common.width, components) if common and common.width else None
    if fitted is None:
        return table.sparkSession.createDataFrame([], kind)
    width, error = common.width, identity_error(vectors, common.width, fitted)
    shares = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(len(fitted.values))

    def run(batches):
        k = len(fitted.values)
        for batch in batches:
            for ids, x in integer_vectors(batch, width):
                away = times_less(x, fitted.n, fitted.sums)
                found, m = fitted.apply(away).reshape(-1), len(x)
                deviation = pa.array([Decimal(s) if s < 10**38 else None for s in squares(away)], pa.decimal128(38, 0))
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)), deviation.take(row), pa.array(found, mask=np.isnan(found)), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, kind)
