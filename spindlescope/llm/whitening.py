"""Embedding whitening: leading principal components by a block Jacobi-Davidson iteration without a covariance matrix.

The only access to the data is the product of the covariance with a thin block of vectors: every task centres its rows, multiplies them
by the block and back, and adds up; the sums are added in Spark and have the size of the block. The driver holds a subspace
of at most ``SPACE`` blocks, does Rayleigh-Ritz in it, locks components whose residual has reached double precision, and
expands it by corrections: MINRES solves (I - PP')(V - e I)(I - PP') t = -r for all open components at once, so a step of the inner
iteration is one distributed product as well.
"""

from __future__ import annotations

import dataclasses
import decimal
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlescope.llm.common import stage, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: An entry beyond this is no whole number of its own any more and counts as not finite.
LARGEST = float(1 << 52)
#: Blocks in the subspace before it is started anew from its best vectors, and how many blocks of these are kept.
SPACE, RESTART = 6, 2
#: Steps of MINRES per correction at most, and the share of the residual at which it stops.
INNER, ENOUGH = 6, 0.05
OUTER = 200
SEED = 13
#: Bytes of a stored partition at least, unless there are fewer partitions than cores.
PART_BYTES = 32 << 20
EPS = np.finfo(float).eps


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Id and x = floor(1024 c) + 100000 per entry, for rows whose vector has no null, NaN, infinite or huge entry.

    Empty vectors and those of another length than most (the shorter one on a tie) are left out too.
    """
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= F.lit(LARGEST / SCALE)), F.lit(False)))
    kept = named.where((F.size("v") > 0) & sound).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT)).alias("x"))
    common = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.where(F.size("x") == F.lit(common["n"] if common else 0))


def matrix_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def total(rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray], d: int, size: int, kind: str = "double") -> np.ndarray:
    """Sum over all rows of the arrays that ``fn`` makes of blocks of rows; ``size`` numbers come to the driver."""
    def part(batches):
        out = np.zeros(size, np.int64 if kind == "bigint" else np.float64)
        for batch in batches:
            if batch.num_rows:
                out += fn(matrix_of(batch, d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], ["pos", "value"])

    sums = rows.select("x").mapInArrow(part, f"pos int, value {kind}").groupBy("pos").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, np.int64 if kind == "bigint" else np.float64)
    for r in sums:
        out[r["pos"]] = r["value"]
    return out


@dataclasses.dataclass(frozen=True)
class Centre:
    """Number of vectors and their sum per dimension, both exact."""

    n: int
    sums: np.ndarray

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: in 64 bits where they hold it, in Python's integers elsewhere."""
        if self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0)) < 1 << 62:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.whole(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n x - S)^2, exact, as decimals of 38 digits; null beyond them."""
        away = self.whole(x)
        most = int(abs(away).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            away = away.astype(np.int64)
            return pa.array((away * away).sum(axis=1)).cast(pa.decimal128(38, 0))
        squares = (away.astype(object) ** 2).sum(axis=1)
        return pa.array([decimal.Decimal(int(s)) if s < 10 ** 38 else None for s in squares], pa.decimal128(38, 0))


def orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``t`` adds to the span of the orthonormal ``bases``; fewer columns if it adds less."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        for b in bases:
            t = t - b @ (b.T @ t)
        if not t.shape[1]:
            break
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-10]
    return t


def corrections(apply: Callable, values: np.ndarray, fixed: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """A few steps of MINRES for each column's correction equation; all columns share the products with the covariance."""
    def operator(v):
        v = v - fixed @ (fixed.T @ v)
        y = apply(v) - v * values
        return y - fixed @ (fixed.T @ y)

    def over(a, b):
        return np.where(b > 0, a / np.where(b > 0, b, 1.0), 0.0)
    b = -residuals / np.maximum(np.linalg.norm(residuals, axis=0), np.finfo(float).tiny)
    b = b - fixed @ (fixed.T @ b)
    k = b.shape[1]
    beta = np.linalg.norm(b, axis=0)
    target, left = ENOUGH * beta, beta.copy()
    before, old, previous, y = np.ones(k), np.zeros_like(b), b, b
    dbar, eps, cs, sn = np.zeros(k), np.zeros(k), -np.ones(k), np.zeros(k)
    x, w, w2 = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    for step in range(INNER):
        v = over(y, beta)
        y = operator(v)
        if step:
            y = y - over(beta, before) * old
        alpha = (v * y).sum(axis=0)
        y = y - over(alpha, beta) * previous
        old, previous = previous, y
        before, beta = beta, np.linalg.norm(y, axis=0)
        beta = np.where(beta > EPS * np.abs(alpha), beta, 0.0)
        former, delta, gbar = eps, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps, dbar = sn * beta, -cs * beta
        gamma = np.hypot(gbar, beta)
        cs, sn = over(gbar, gamma), over(beta, gamma)
        phi, left = cs * left, sn * left
        w, w2 = over(v - former * w2 - delta * w, gamma), w
        x = x + phi * w
        if (left <= target).all():
            break
    return x


def leading_components(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues, falling, and unit eigenvectors of the symmetric operator ``apply`` on blocks (d, any).

    A component is locked when its residual is at most d roundings of the greatest eigenvalue, or when residuals have stopped
    shrinking within a thousand times that. With equal eigenvalues, any basis of their space comes out.
    """
    k = min(k, d)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, RESTART * k))))[0]
    a = apply(q)
    locked, values = np.zeros((d, 0)), []
    least, stalled = np.inf, 0
    for _ in range(OUTER):
        h = q.T @ a
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        q, a = q @ s, a @ s
        want = k - len(values)
        r = a[:, :want] - q[:, :want] * theta[:want]
        size = np.linalg.norm(r, axis=0)
        top = max([*values, theta[0], 0.0])
        stalled = stalled + 1 if size.max() > least / 2 else 0
        least = min(least, size.max())
        limit = d * EPS * top * (1000 if stalled > 4 or q.shape[1] + len(values) >= d else 1)
        done = int(np.argmin(size <= limit)) if (size > limit).any() else want
        if done:
            locked, values = np.hstack([locked, q[:, :done]]), [*values, *theta[:done]]
            q, a, r, least, stalled = q[:, done:], a[:, done:], r[:, done:], np.inf, 0
            theta, want = theta[done:], want - done
        if not want:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        if q.shape[1] > SPACE * k:
            q, a = q[:, :RESTART * k], a[:, :RESTART * k]
        found = corrections(apply, theta[:want], np.hstack([locked, q[:, :want]]), r)
        t = orthonormal(found, locked, q)
        if not t.shape[1]:
            t = orthonormal(np.random.default_rng(seed + len(values)).standard_normal((d, want)), locked, q)
        if t.shape[1]:
            q, a = np.hstack([q, t]), np.hstack([a, apply(t)])
        else:  # the whole space: nothing can be added, so its products are formed anew
            a = apply(q)
    raise ArithmeticError(f"components did not converge: residual {size.max() / top:.1e} of the greatest eigenvalue")


@dataclasses.dataclass(frozen=True)
class Whitening:
    """Components of a table of vectors: ``values`` fall, ``vectors`` are columns; ``rank`` of them have any variance."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    products: int

    @property
    def rank(self) -> int:
        return int((self.values > len(self.centre.sums) * EPS * max(self.values.max(initial=0.0), 0.0)).sum())

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ (self.vectors[:, :self.rank] / np.sqrt(self.values[:self.rank]))


def fit(vectors: DataFrame, components: int = COMPONENTS, seed: int = SEED) -> Whitening | None:
    """Components of all rows of ``vectors`` (vec_id, x), which is read once per product: give a stored table. None if it is empty."""
    first = vectors.select("x").first()
    if first is None:
        return None
    d = len(first["x"])
    n = vectors.count()
    centre = Centre(n, total(vectors, lambda x: x.sum(axis=0), d, d, "bigint"))
    trace = float(total(vectors, lambda x: np.square(centre(x)).sum(), d, 1)[0]) / n
    products = [0]

    def apply(block: np.ndarray) -> np.ndarray:
        products[0] += 1

        def both_ways(x):
            c = centre(x)
            return c.T @ (c @ block)
        return total(vectors, both_ways, d, block.size).reshape(block.shape) / n

    values, found = leading_components(apply, d, components, seed)
    return Whitening(centre, values, found, trace, products[0])


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry, without sign, of the whitened rows' covariance minus the identity; over the components with variance."""
    d, k, n = len(model.centre.sums), model.rank, model.centre.n
    if not k:
        return 0.0
    mean = total(vectors, lambda x: model.whiten(x).sum(axis=0), d, k) / n

    def squares(x):
        w = model.whiten(x) - mean
        return w.T @ w
    return float(np.abs(total(vectors, squares, d, k * k).reshape(k, k) / n - np.eye(k)).max())


def stored(vectors: DataFrame) -> DataFrame:
    """``vectors`` written for many scans: large partitions, but one per core where the table is small."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    size = vectors.agg(F.sum(F.size("x")).alias("s")).first()["s"] or 0
    return stage(vectors.coalesce(max(cores, -(-8 * size // PART_BYTES))))


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained), components from 1.

    A component without variance (fewer vectors than dimensions, equal vectors) has whitened null and explained 0 or nearly so.
    """
    d, k = len(model.centre.sums), len(model.values)
    share = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.values]

    def project(batches):
        for batch in batches:
            x = matrix_of(batch, d)
            rows = len(x)
            w = np.full((rows, k), np.nan)
            w[:, :model.rank] = model.whiten(x)
            again = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.centre.n)),
                 model.centre.deviations(x).take(again), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, rows))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(project, f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double")


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """All sound embeddings on their eight leading components, scaled to unit variance. A deviation beyond a long is null.

    Empty tables have no rows. Repeated rows and rows without an id count and come out like others; other columns are left behind.
    """
    vectors = stored(whole_vectors(table(spark, sf_dir, "embeddings")))
    model = fit(vectors)
    if model is None:
        return spark.range(0).selectExpr("id AS vec_id", "1 AS component", "id AS n", "id AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    return whitened(vectors, model).select("vec_id", "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained",
                                           F.lit(identity_error(vectors, model)).alias("identity_error"))
