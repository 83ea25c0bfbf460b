"""Embedding whitening by QDWH spectral divide and conquer.

1. Vectors become whole numbers (floor(scale * c) + shift). One scan gives a
   row of moments per task: count, exact sums, and the products of entries
   centred at the task's own mean. Spark adds them up; only the d x d
   covariance (``MAX_DIM`` bounds it) reaches the driver.
2. The covariance, shifted, is split by polar decompositions (QDWH: weighted
   Halley steps by QR while ill-conditioned, by Cholesky after). The
   orthogonal polar factor gives the projectors on the spaces above and below
   the shift; the covariance restricted to each is split in turn, until
   nothing but its diagonal is left.
3. The projection and its scale are broadcast; one more scan measures the
   covariance of the whitened rows, and a last one returns them.

Edge cases: rows whose vector is null, or holds null or non-finite entries, or
entries of 2^40 and more, are dropped; so are rows of another length than most
(the longer of two lengths that are as frequent). Repeated rows count and are
returned each time. Directions without variance (below the rounding of the
largest) are no components, so equal vectors give no rows; an empty table
gives none. A deviation beyond 64 bits is null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship_code

#: Largest dimension: the broadcast projection and the driver's covariance
#: hold at most MAX_DIM^2 doubles (32 MB).
MAX_DIM = 2048
#: Entries beyond are treated like non-finite ones: sums of products stay exact.
LARGEST = float(1 << 40)
_EPS = np.finfo(float).eps


# -- spectral divide and conquer ------------------------------------------
def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal (here symmetric) polar factor of a regular symmetric matrix,
    by dynamically weighted Halley steps."""
    m = len(a)
    x = a / np.linalg.norm(a)
    low = min(1.0, max(_EPS, 1 / np.linalg.norm(np.linalg.inv(x))))  # at most the least singular value
    for _ in range(30):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        wa = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(m)]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:m] @ q[m:].T
        else:
            lower = np.linalg.cholesky(np.eye(m) + wc * x.T @ x)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low ** 2) / (1 + wc * low ** 2))
        moved, x = np.linalg.norm(new - x), new
        if moved < np.cbrt(_EPS) / 10 and 1 - low < 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant spaces above and below a shift."""
    m, diagonal = len(a), np.diag(a)
    spread = np.linalg.norm(a - np.diag(np.full(m, diagonal.mean())))  # 0 only for a multiple of the identity
    shifts = [np.median(diagonal), diagonal.mean()] + [
        diagonal.mean() + s * spread / m for s in rng.uniform(-0.5, 0.5, 20)]
    for shift in shifts:
        shifted = a - shift * np.eye(m)
        try:
            above = (polar_factor(shifted) + np.eye(m)) / 2
        except np.linalg.LinAlgError:  # the shift is an eigenvalue
            continue
        k = int(round(np.trace(above)))
        if not 0 < k < m or np.linalg.norm(above @ above - above) > 1e-8:
            continue
        start = rng.standard_normal((m, m))
        bases = []
        for projector, own in ((above, start[:, :k]), (np.eye(m) - above, start[:, k:])):
            for _ in range(2):  # the second turn removes what rounding brought in
                own, _ = np.linalg.qr(projector @ own)
            bases.append(own)
        both = np.hstack(bases)
        both, r = np.linalg.qr(both)
        both = both * np.sign(np.diag(r))
        return both[:, :k], both[:, k:]
    return None


def spectral_components(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric
    matrix."""
    rng, d = np.random.default_rng(13), len(cov)
    noise = _EPS * np.linalg.norm(cov)
    todo, vectors = [np.eye(d)], []
    while todo:
        basis = todo.pop()
        own = basis.T @ cov @ basis
        own = (own + own.T) / 2
        off = own - np.diag(np.diag(own))
        bases = None if len(own) == 1 or np.linalg.norm(off) <= noise else _split(own, rng)
        if bases is None:
            vectors.append(basis)
        else:
            todo += [basis @ b for b in bases]
    v = np.hstack(vectors)
    # re-orthogonalise, then one first-order step: rotate by what is left
    # beside the diagonal, over the gap of the eigenvalues
    v, r = np.linalg.qr(v)
    v = v * np.sign(np.diag(r))
    left = v.T @ cov @ v
    e = np.diag(left).copy()
    gap = e[None, :] - e[:, None]
    near = np.abs(gap) <= 1e3 * noise
    turn = np.where(near, 0, (left - np.diag(e)) / np.where(near, 1, gap))
    v, r = np.linalg.qr(v + v @ turn)
    v = v * np.sign(np.diag(r))
    e = np.einsum("ij,ij->j", v, cov @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


# -- moments --------------------------------------------------------------
class Moments:
    """Count, mean and centred products of rows, joined batch by batch."""

    def __init__(self, d: int):
        self.n, self.mean, self.products = 0, np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        mean = rows.mean(axis=0)
        centred = rows - mean
        n, delta = self.n + len(rows), mean - self.mean
        self.products += centred.T @ centred + np.outer(delta, delta) * (self.n * len(rows) / n)
        self.mean += delta * (len(rows) / n)
        self.n = n


def _cells(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def _joined(parts: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Count and covariance over the rows of all tasks: their centred products
    and the spread of their means around the mean of all, added up by cell."""
    n = parts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return 0, np.zeros((d, d))
    sums = (parts.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i")
            .agg(F.sum(F.col("n") * F.col("m"))).collect())  # d rows
    mean = np.zeros(d)
    for i, s in sums:
        mean[i] = s / n
    at = _cells(d)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at[0]))
        for batch in batches:
            for k, m, own in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "products")), strict=True):
                delta = np.array(m) - mean
                total += np.array(own) + k * delta[at[0]] * delta[at[1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                         names=["cell", "value"])

    cov = np.zeros((d, d))
    cells = parts.select("n", "mean", "products").mapInArrow(spread, "cell int, value double")
    for cell, value in cells.groupBy("cell").agg(F.sum("value")).collect():  # d (d + 1) / 2 rows
        i, j = at[0][cell], at[1][cell]
        cov[i, j] = cov[j, i] = value / n
    return n, cov


@dataclass(frozen=True)
class Whitening:
    """Fitted on n vectors: exact sums, components (columns), eigenvalues and
    the trace of the covariance."""
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    scale: int
    shift: int


def _whole(batch: pa.RecordBatch, d: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the batch's usable vectors, and these as whole numbers."""
    column = batch.column("vec")
    size = np.array(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == d)
    flat = column.take(pa.array(rows)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)  # a null entry becomes NaN
    with np.errstate(invalid="ignore"):
        usable = (np.abs(values) < LARGEST).all(axis=1)
    return rows[usable], np.floor(scale * values[usable]).astype(np.int64) + shift


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))


def fit_whitening(df: DataFrame, vec_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """Fit on all usable vectors of ``df``; None if there are none."""
    spark = df.sparkSession
    ship_code(spark)
    rows = df.select(F.col(vec_col).alias("vec")).filter(F.col("vec").isNotNull())
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or most["d"] < 1:
        return None
    d = most["d"]
    if d > MAX_DIM:
        raise ValueError(f"{d} dimensions; at most {MAX_DIM}")
    at = _cells(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, sums = Moments(d), np.zeros(d, np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                _, x = _whole(batch.slice(lo, 2000), d, scale, shift)
                sums += x.sum(axis=0)
                moments.add((x - shift).astype(float))  # nearer to 0: less rounding, the same products
        if moments.n:
            yield pa.RecordBatch.from_pylist([{"n": moments.n, "sums": sums.tolist(), "mean": moments.mean.tolist(),
                                               "products": moments.products[at].tolist()}])

    parts = Scratch(spark, "whitening").write(
        rows.mapInArrow(run, "n long, sums array<long>, mean array<double>, products array<double>"), "moments")
    n, cov = _joined(parts, d)
    if not n:
        return None
    sums = dict(parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s")).collect())
    values, components = spectral_components(cov)
    kept = values > d * _EPS * max(values[0], 0)
    return Whitening(n, [sums[i] for i in range(d)], components[:, kept], values[kept], float(np.trace(cov)), scale, shift)


def whiten(df: DataFrame, model: Whitening, components: int = 32, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """Usable rows: id, ``deviation`` (exact) and ``whitened`` (array)."""
    ship_code(df.sparkSession)
    rows = _vectors(df, id_col, vec_col)
    n, sums, d = model.n, np.array(model.sums, np.int64), len(model.sums)
    mean = sums / n
    projection = df.sparkSession.sparkContext.broadcast(
        model.components[:, :components] / np.sqrt(model.values[:components]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                at, x = _whole(part, d, model.scale, model.shift)
                if not len(at):
                    continue
                z = (x - mean) @ projection.value
                delta = [[n * int(c) - s for c, s in zip(row, model.sums, strict=True)] for row in x] \
                    if n * float(np.abs(x).max()) > 2.0 ** 62 else n * x - sums
                if not isinstance(delta, list) and (delta.astype(float) ** 2).sum(axis=1).max() < 2.0 ** 62:
                    deviation = pa.array((delta * delta).sum(axis=1), pa.int64())
                else:  # whole numbers of any size
                    exact = [sum(int(c) * int(c) for c in row) for row in delta]
                    deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
                offsets = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32) if z.shape[1] \
                    else np.zeros(len(z) + 1, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(at)), deviation,
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))],
                    names=["id", "deviation", "whitened"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest entry of the covariance of ``whitened`` minus the identity."""
    at = _cells(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = Moments(k)
        for batch in batches:
            moments.add(batch.column("whitened").flatten().to_numpy().reshape(-1, k))
        if moments.n:
            yield pa.RecordBatch.from_pylist([{"n": moments.n, "mean": moments.mean.tolist(),
                                               "products": moments.products[at].tolist()}])

    parts = Scratch(whitened.sparkSession, "whitening").write(
        whitened.select("whitened").mapInArrow(run, "n long, mean array<double>, products array<double>"), "moments")
    return float(np.abs(_joined(parts, k)[1] - np.eye(k)).max())


def whitened_components(df: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding",
                        scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row per usable vector and component: id, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    schema = (f"{id_col} {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    model = fit_whitening(df, vec_col, scale, shift)
    k = min(components, len(model.values)) if model else 0
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    rows = whiten(df, model, components, id_col, vec_col)
    error = identity_error(rows, k)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:k]])
    return (rows.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", share[F.col("at")].alias("explained"),
                    F.lit(error).alias("identity_error")))
