"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of their centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, packed, partition_count, unpacked, whole_vectors

#: The largest double below 2**63: entries beyond it count as it.
LONGEST = 2.0**63 - 1024
#: Singular values below this share of the rows' norm count as zero.
NOISE = 1e-11
#: A component has converged when its residual is below this share of the largest singular value.
TOLERANCE = 1e-14
#: Numbers that a task adds up over others' sums.
SUMS = 1 << 20
#: Between two looks at convergence.
LOOK = 8


@dataclass
class Centre:
    """The mean S / n of a list of whole vectors, as whole part and fraction, so that centring rounds once."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        if x.dtype.kind == "i":
            return (x.astype(np.int64) - self.whole).astype(np.float64) - self.rest
        return x - self.whole.astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2 for each row, exactly; None where no long holds it.

        Sums of 64 bits wrap around, which leaves them right where the true value fits; a double
        tells whether it does, and Python's integers near the limit.
        """
        x = x.astype(np.int64)
        near = ((x.astype(np.float64) * self.n - np.array(self.sums, np.float64)) ** 2).sum(axis=1)
        wrapped = np.array([s % 2**64 for s in self.sums], np.uint64)
        d = x.view(np.uint64) * np.uint64(self.n) - wrapped
        exact = (d * d).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()
        for i in np.flatnonzero(near > 2.0**62).tolist():
            v = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[i].tolist(), self.sums, strict=True)) if near[i] < 2.0**64 else 2**63
            exact[i] = v if v < 2**63 else None
        return exact


def _summed(blocks: DataFrame, dim: int, f: Callable[[np.ndarray], np.ndarray], size: int, tasks: int) -> np.ndarray:
    """The sum over all blocks of f(rows), a vector of doubles: each of some `tasks` tasks adds up its own, and the sums are added by place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in unpacked(batches, dim):
            total += f(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    sums = blocks.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    # as few tasks for the sums as their numbers need
    got = sums.coalesce(1 + tasks * size // SUMS).collect()
    out = np.zeros(size)
    for r in got:
        out[r["i"]] = r["v"]
    return out


def centre(blocks: DataFrame, dim: int) -> Centre:
    """Number and exact sums of the vectors in blocks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for x in unpacked(batches, dim):
            x = x.astype(np.int64)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    got = {r["i"]: int(r["high"]) * 2**32 + int(r["low"]) for r in blocks.mapInArrow(add, "i long, high long, low long").groupBy("i").agg(*exact).coalesce(1 + dim // SUMS).collect()}
    return Centre(blocks.agg(F.sum("n")).first()[0] or 0, [got.get(i, 0) for i in range(dim)])


class Bidiagonal:
    """Leading singular triplets of centred rows X that tasks hold.

    Each step is one pass: tasks form u = X z, its products with all u before it, and X'u. A u lies in
    the columns of X, so u = X z for a z of `dim` numbers, and no vector with an entry for each
    row is ever kept: only the z. What the driver holds is some dim x dim matrices.
    """

    def __init__(self, blocks: DataFrame, dim: int, mean: Centre, norm: float, seed: int, tasks: int) -> None:
        self.blocks, self.dim, self.mean, self.norm, self.tasks = blocks, dim, mean, norm, tasks
        self.random = np.random.default_rng(seed)
        self.sigma: list[float] = []
        self.right: list[np.ndarray] = []  # what is found: unit vectors v, by falling sigma

    def _pass(self, z: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(X'u, products of u with X @ before, |u|**2) of u = X z."""
        dim, k, mean = self.dim, before.shape[1], self.mean

        def products(x: np.ndarray) -> np.ndarray:
            a = mean.rows(x)
            u = a @ z
            return np.concatenate([u @ a, u @ (a @ before), [u @ u]])

        got = _summed(self.blocks, dim, products, dim + k + 1, self.tasks)
        return got[:dim], got[dim : dim + k], float(got[-1])

    @staticmethod
    def _away(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
        """w without its part in the basis, taken off twice."""
        if basis:
            b = np.stack(basis, axis=1)
            for _ in range(2):
                w = w - b @ (b.T @ w)
        return w

    def _run(self, wanted: int) -> tuple[list[tuple[float, np.ndarray]], bool]:
        """Triplets of X away from what is found: (sigma, v) by falling sigma, and whether nothing is left outside them."""
        held = [(s, v) for s, v in zip(self.sigma, self.right, strict=True) if s > NOISE * self.norm]
        zs, gs = [v / s for s, v in held], [v * s for s, v in held]
        first = len(zs)
        v = self._away(self.random.normal(size=self.dim), self.right)
        vs, alpha, beta = [v / np.linalg.norm(v)], [], []
        while True:
            z = vs[-1] - beta[-1] * zs[-1] if beta else vs[-1]
            before = np.stack(zs, axis=1) if zs else np.zeros((self.dim, 0))
            g, c, s = self._pass(z, before)
            size = np.sqrt(max(0.0, s - c @ c))
            if size <= NOISE * self.norm:
                break  # X v is among the u before it: a row of zeros ends the bidiagonal matrix
            z, g = z - before @ c, g - (np.stack(gs, axis=1) @ c if gs else 0)
            alpha.append(size)
            zs.append(z / size)
            gs.append(g / size)
            w = self._away(gs[-1] - size * vs[-1], self.right + vs)
            after = np.linalg.norm(w)
            k = len(alpha)
            if after <= NOISE * self.norm or k + len(self.right) == self.dim:
                break
            if k >= wanted and k % LOOK == 0 and 2 * k <= self.dim:
                left, sv, right = np.linalg.svd(_matrix(alpha, beta, k))
                if (after * np.abs(left[-1, :wanted]) <= TOLERANCE * max(sv[0], *self.sigma[:1], 0)).all():
                    return [(sv[i], np.stack(vs, axis=1) @ right[i]) for i in range(wanted)], False
            beta.append(after)
            vs.append(w / after)
        _, sv, right = np.linalg.svd(_matrix(alpha, beta, len(vs)), full_matrices=True)
        sv = np.concatenate([sv, np.zeros(len(vs) - len(sv))])
        return [(s, np.stack(vs, axis=1) @ q) for s, q in zip(sv, right, strict=True)], len(vs) + len(self.right) == self.dim

    def leading(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(singular values, vectors as columns) of the largest ones above zero.

        A run sees one direction of each singular value, so runs go on in what is left until one
        finds none above those wanted.
        """
        while self.norm > 0 and len(self.sigma) < self.dim:
            new, whole = self._run(wanted)
            enough = len(self.sigma) >= wanted and new[0][0] <= self.sigma[wanted - 1]
            both = sorted([*zip(self.sigma, self.right, strict=True), *new], key=lambda t: -t[0])
            self.sigma, self.right = [float(s) for s, _ in both], [v for _, v in both]
            if whole or enough or new[0][0] <= NOISE * self.norm:
                break
        live = [i for i, s in enumerate(self.sigma[:wanted]) if s > NOISE * self.norm]
        v = [self.right[i] * np.sign(self.right[i][np.argmax(np.abs(self.right[i]))]) for i in live]
        return np.array([self.sigma[i] for i in live]), np.stack(v, axis=1) if v else np.zeros((self.dim, 0))


def _matrix(alpha: list[float], beta: list[float], columns: int) -> np.ndarray:
    """Upper bidiagonal, as many rows as alphas."""
    out = np.zeros((len(alpha), columns))
    for i, a in enumerate(alpha):
        out[i, i] = a
    for i, b in enumerate(beta[: len(alpha)]):
        out[i, i + 1] = b
    return out


_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, seed: int = 11) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error, for each row and component.

    Entries become x = floor(scale * c). Fitted on each distinct x vector once: n of them, with
    sums S. Components are unit eigenvectors of their covariance (divisor n) by falling eigenvalue
    e, their largest entry positive. deviation: sum of (n * x - S)**2, null where no long holds
    it. whitened: (x - S / n) projected, over sqrt(e). explained: e over the covariance's trace.
    identity_error: how far the covariance of whitened over the fit list is from the identity, at most.

    Rows are left out whose vector is null, has null or non-finite entries, or has another length than
    most. Null ids stay null, repeated rows count each as results and once in the fit. Eigenvalues
    of zero (equal vectors, fewer dimensions than components) give no component, so a table of one
    vector, or none, gives no rows. Entries that no long holds count as the nearest one.

    The fit list is deduplicated by a shuffle and written as blocks; every step reads those once and gives
    one row a place and task. Rows are projected where they lie.
    """
    x, dim, largest, n_rows = whole_vectors(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("__v")), "__v", scale)
    spark = vectors.sparkSession
    if dim == 0:
        return spark.createDataFrame([], _ROWS)
    if largest > LONGEST:
        x = x.withColumn("__x", F.transform("__x", lambda c: F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), c))))
    blocks = packed(x.select("__x").distinct(), dim, n_rows)
    mean, tasks = centre(blocks, dim), partition_count(n_rows, dim)
    squares = _summed(blocks, dim, lambda rows: np.array([(mean.rows(rows) ** 2).sum()]), 1, tasks)[0]
    sigma, v = Bidiagonal(blocks, dim, mean, float(np.sqrt(squares)), seed, tasks).leading(components)
    k = len(sigma)
    if k == 0:
        return spark.createDataFrame([], _ROWS)
    project = v / (sigma / np.sqrt(mean.n))

    def moments(rows: np.ndarray) -> np.ndarray:
        w = mean.rows(rows) @ project
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _summed(blocks, dim, moments, k + k * k, tasks) / mean.n
    error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    explained = sigma**2 / squares

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("__x"), dim)
            each = pa.array(np.repeat(np.arange(len(m)), k))
            columns = {
                "vec_id": b.column("vec_id").take(each),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                "n": pa.array(np.full(len(m) * k, mean.n, np.int64)),
                "deviation": pa.array(mean.deviations(m), pa.int64()).take(each),
                "whitened": pa.array((mean.rows(m) @ project).ravel()),
                "explained": pa.array(np.tile(explained, len(m))),
                "identity_error": pa.array(np.full(len(m) * k, error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return x.select("vec_id", "__x").mapInArrow(rows, _ROWS)
