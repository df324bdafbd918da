"""Whitening of embeddings by exact covariances from sums of squares.

Entries are whole numbers, floor(scale * entry) + shift, so their covariance has
an exact value. It is found by polarisation: for every dimension i and every pair
i < j the tasks sum the squares of the centred values y_i and of the centred sums
y_i + y_j; since 2 cov(i, j) = var(i + j) - var(i) - var(j), these variances give all
cross-covariances. Values are centred at m = floor(mean), so that squares stay small,
and the rest of the mean is taken out exactly: with r = sum(y),
sum((n x - S)^2) = n^2 sum(y^2) - n r^2. Sums leave the tasks as limbs of 30 bits and
are added up by Spark as longs: no rounding and no overflow at any number of rows.

Only the covariance matrix, in doubles, comes to the driver for eigh: dimensions
squared, whatever the number of rows. The components, scaled by their standard
deviation, go to the tasks, which project the rows.

Defined cases: vectors that are null or empty or hold a null or non-finite entry
take no part. Vectors of each length are a space of their own, fitted apart. An entry
beyond a long counts as the nearest long. A component without variance (all rows
alike, or fewer rows than dimensions) has no scale: its whitened values are null, and
the identity is checked without it. Keys may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LIMB = 30
#: Rows that are squared at once; magnitude of centred values up to which their sums fit in longs.
ROWS, SMALL = 1024, 1 << 24


class Space(NamedTuple):
    """The fit of the vectors of one length. scaled: dimensions x components, unit eigenvectors over the standard deviation."""

    n: int
    sums: list[int]
    scaled: np.ndarray
    explained: np.ndarray
    #: Largest absolute entry of the whitened values' covariance minus the identity.
    identity_error: float = 0.0


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    given = vector.cast("array<double>")
    return F.coalesce((F.size(given) > 0) & F.forall(given, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _whole(column: pa.Array, size: int, scale: float, shift: int) -> np.ndarray:
    """Rows x size whole numbers; of Python's integers where a long doesn't hold what is computed with them."""
    c = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, size)
    if np.abs(c).max(initial=0) < 2.0**52:
        return c.astype(np.int64) + shift
    whole = np.array([min(max(int(v) if abs(v) < 2.0**80 else (1 << 80) * (1 if v > 0 else -1), -(1 << 80)), 1 << 80) + shift for v in c.ravel()], object).reshape(c.shape)
    return np.clip(whole, -(1 << 63), (1 << 63) - 1)


def _by_length(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of the batches with vectors of one length each."""
    for batch in batches:
        sizes = np.asarray(batch.column(place).value_lengths())
        for size in np.unique(sizes):
            some = batch.filter(pa.array(sizes == size))
            for i in range(0, len(some), ROWS):
                yield int(size), some.slice(i, ROWS)


def _limbs(size: int, i: int, total: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(size, i, j, limb, value) of whole numbers; the last limb has the sign."""
    for j, v in enumerate(total.tolist()):
        limb = 0
        while not -(1 << LIMB) <= v < 1 << LIMB:
            yield size, i, i + j, limb, v & ((1 << LIMB) - 1)
            v >>= LIMB
            limb += 1
        yield size, i, i + j, limb, v


def _summed(tasks: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """The exact total of each (i, j) of each length, from the tasks' limbs."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in tasks.groupBy("size", "i", "j", "limb").agg(F.sum("value").alias("value")).toLocalIterator():
        of_size = out.setdefault(r["size"], {})
        of_size[r.i, r.j] = of_size.get((r.i, r.j), 0) + (r.value << (LIMB * r.limb))
    return out


_LIMBS = "size int, i int, j int, limb int, value long"


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 4 + [pa.int64()], strict=True)], names=["size", "i", "j", "limb", "value"])


def _means(vectors: DataFrame, scale: float, shift: int) -> dict[int, tuple[int, list[int]]]:
    """length -> number of rows, sum of each dimension."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for size, some in _by_length(batches, 0):
            x = _whole(some.column(0), size, scale, shift)
            got = np.append(x.astype(object).sum(0) if x.dtype == object or np.abs(x).max() > SMALL else x.sum(0).astype(object), len(x))
            totals[size] = totals.get(size, 0) + got
        yield _as_batch([row for size, total in totals.items() for row in _limbs(size, 0, total)])

    found = _summed(vectors.mapInArrow(run, _LIMBS))
    return {size: (total[0, size], [total[0, j] for j in range(size)]) for size, total in found.items()}


def _squares(vectors: DataFrame, centres: dict[int, list[int]], scale: float, shift: int) -> dict[int, dict[tuple[int, int], int]]:
    """length -> (i, j) -> sum of (y_i + y_j)^2, for i = j of y_i^2."""

    def run(batches):
        totals: dict[int, list[np.ndarray]] = {}
        for size, some in _by_length(batches, 0):
            y = _whole(some.column(0), size, scale, shift)
            if y.dtype == object or max(map(abs, centres[size])) >= 1 << 62:
                y = y.astype(object) - np.array(centres[size], object)
            else:
                y = y - np.array(centres[size], np.int64)
                if np.abs(y).max() > SMALL:
                    y = y.astype(object)
            of_size = totals.setdefault(size, [np.zeros(size - i, object) for i in range(size)])
            for i in range(size):
                pairs = y[:, i:] + y[:, i : i + 1]
                pairs[:, 0] = y[:, i]
                of_size[i] = of_size[i] + (pairs * pairs).sum(0).astype(object)
        for size, of_size in totals.items():
            for i, total in enumerate(of_size):
                yield _as_batch(list(_limbs(size, i, total)))

    return _summed(vectors.mapInArrow(run, _LIMBS))


def _space(n: int, sums: list[int], squares: dict[tuple[int, int], int], components: int) -> Space:
    size = len(sums)
    rest = [s - n * (s // n) for s in sums]
    scatter = np.zeros((size, size))
    for i in range(size):
        scatter[i, i] = (n * squares[i, i] - rest[i] ** 2) / n**2
        for j in range(i + 1, size):
            # n^2 times the covariance, whole; the division rounds once
            both = n * (squares[i, j] - squares[i, i] - squares[j, j]) - 2 * rest[i] * rest[j]
            scatter[i, j] = scatter[j, i] = both / (2 * n**2)
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(scatter))
    top = min(components, size)
    real = values[:top] > size * np.finfo(float).eps * max(values[0], 0)
    scaled = np.where(real, vectors[:, :top] / np.sqrt(np.where(real, values[:top], 1)), np.nan)
    return Space(n, sums, scaled, values[:top] / trace if trace > 0 else np.zeros(top))


def _deviation(y: np.ndarray, space: Space) -> list[int]:
    """The sum over dimensions of (n x - S)^2 for each row, exactly. y: x without the floor of the mean."""
    rest = [s % space.n for s in space.sums]
    most = space.n * (int(np.abs(y).max(initial=0)) + 1)
    if y.dtype != object and y.shape[1] * most * most < 1 << 63:
        d = space.n * y - np.array(rest, np.int64)
    else:
        d = space.n * y.astype(object) - np.array(rest, object)
    return (d * d).sum(1).tolist()


def _centred(column: pa.Array, size: int, space: Space, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers without the floor of the mean, and doubles without all of it."""
    whole = [s // space.n for s in space.sums]
    x = _whole(column, size, scale, shift)
    y = x - np.array(whole, np.int64) if x.dtype != object and max(map(abs, whole)) < 1 << 62 else x.astype(object) - np.array(whole, object)
    return y, y.astype(np.float64) - np.array([(s % space.n) / space.n for s in space.sums])


def _identity_errors(vectors: DataFrame, spaces: dict[int, Space], scale: float, shift: int) -> dict[int, float]:
    """Measured on the whitened rows: their sums and products, which are of bounded size, added up over all tasks."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for size, some in _by_length(batches, 0):
            _, centred = _centred(some.column(0), size, spaces[size], scale, shift)
            w = np.hstack([centred @ spaces[size].scaled, np.ones((len(some), 1))])
            totals[size] = totals.get(size, 0) + w.T @ w
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.ravel().tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["size", "sums"])

    cells = vectors.mapInArrow(run, "size int, sums array<double>").select("size", F.posexplode("sums").alias("at", "v")).groupBy("size", "at").agg(F.sum("v").alias("v"))
    sums: dict[int, np.ndarray] = {size: np.zeros((s.scaled.shape[1] + 1) ** 2) for size, s in spaces.items()}
    for r in cells.toLocalIterator():
        sums[r["size"]][r["at"]] = r.v
    out = {}
    for size, space in spaces.items():
        total = sums[size].reshape(space.scaled.shape[1] + 1, -1) / space.n
        off = np.abs(total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1]) - np.eye(len(total) - 1))
        out[size] = float(off[~np.isnan(off)].max(initial=0))
    return out


def fit(vectors: DataFrame, *, vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, components: int = 32) -> dict[int, Space]:
    """length -> Space of all usable vectors of that length."""
    own = vectors.where(usable(F.col(vector))).select(F.col(vector).alias("v"))
    means = _means(own, scale, shift)
    if not means:
        return {}
    squares = _squares(own, {size: [s // n for s in sums] for size, (n, sums) in means.items()}, scale, shift)
    spaces = {size: _space(n, sums, squares[size], components) for size, (n, sums) in means.items()}
    errors = _identity_errors(own, spaces, scale, shift)
    return {size: space._replace(identity_error=errors[size]) for size, space in spaces.items()}


def whiten(vectors: DataFrame, spaces: dict[int, Space], *, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """key, n, deviation (decimal, null beyond 38 digits), whitened, explained, identity_error of each usable vector.

    whitened and explained are arrays by falling eigenvalue.
    """
    kind = dict(vectors.select(key).dtypes)[key]

    def run(batches):
        for size, some in _by_length(batches, 1):
            space = spaces[size]
            y, centred = _centred(some.column(1), size, space, scale, shift)
            white = [[None if np.isnan(v) else v for v in row] for row in (centred @ space.scaled).tolist()]
            deviation = [Decimal(d) if d < 10**38 else None for d in _deviation(y, space)]
            same = lambda v, t: pa.array([v] * len(some), t)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), same(space.n, pa.int64()), pa.array(deviation, pa.decimal128(38, 0)), pa.array(white, pa.list_(pa.float64())), same(space.explained.tolist(), pa.list_(pa.float64())), same(space.identity_error, pa.float64())],
                names=["key", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    own = vectors.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    return own.mapInArrow(run, f"key {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double").withColumnRenamed("key", key)
