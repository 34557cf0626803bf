"""Embedding whitening by QDWH spectral divide and conquer.

Vectors are quantised (entry c becomes floor(64 c) + 1000000), each distinct one is fitted once, and a vector's deviations from the
mean are projected on the principal components and divided by the standard deviation there.

* Sums, and products of centred rows, are added up in the tasks, and added by entry after a shuffle; of a fit the driver gets d x d numbers,
  d being the length of a vector (some 30 MB at 2,000), whatever the number of rows.
* Components: the polar factor U of V - s I, found by dynamically weighted Halley steps in QR form, has eigenvalues 1 and -1, so
  (U + I) / 2 projects on the invariant subspace of V above the shift s.  V is reduced to the subspaces above and below, which are split
  again, to single components.  Last, the basis is polished by steps on the rotated matrix, to double precision.
* Mean, components and scales are broadcast (d x TOP numbers), and all rows are whitened where they are.

Defined cases: rows without vector, or whose vector has null or non-finite entries or entries of 2^46 and more (which no long holds once
scaled), go; so do empty vectors and vectors whose length is not the most frequent one (of equally frequent ones: the greatest); rows with
one vec_id, or none, each get their rows; a component without variance (an eigenvalue under d x 10^-14 of the
largest) is left out, so one distinct vector gives no rows; a deviation that no long holds is null; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, OFFSET, TOP = 64, 1_000_000, 16
#: Rows centred and multiplied at once.
BLOCK = 4096
EPS = np.finfo(float).eps


def polar(a: np.ndarray, least: float) -> np.ndarray:
    """The orthogonal polar factor of symmetric ``a``, whose singular values, divided by the largest, are ``least`` or more."""
    x, low = a / np.linalg.norm(a, 2), max(least, 1e-17)
    n, one = len(a), np.eye(len(a))
    for _ in range(40):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        w = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)))
        w2 = (w - 1) ** 2 / 4
        c = w + w2 - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
        y = w2 / c * x + (w - w2 / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        y = (y + y.T) / 2
        low = min(1.0, low * (w + w2 * l2) / (1 + c * l2))
        done = np.linalg.norm(y - x) < 1e-10 and abs(1 - low) < 1e-12
        x = y
        if done:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of ``a`` above and below a shift; None if no shift tells eigenvalues apart."""
    n = len(a)
    center, spread = np.trace(a) / n, np.linalg.norm(a - np.eye(n) * np.trace(a) / n)
    if spread <= n * EPS * max(np.linalg.norm(a), 1e-300):
        return None  # one eigenvalue
    tries = [float(np.median(np.diag(a))), center, center + spread / n, center - spread / n, center + spread / n**0.5, center - spread / n**0.5]
    for shift in tries:
        moved = a - shift * np.eye(n)
        size = np.linalg.norm(moved, 2)
        inverse = np.linalg.cond(moved)
        if not np.isfinite(inverse) or inverse > 1e14 or size == 0:
            continue  # the shift meets an eigenvalue
        projector = (polar(moved, 0.9 / inverse) + np.eye(n)) / 2
        above = int(round(np.trace(projector)))
        if 0 < above < n:
            # the projector's largest columns span the subspace above; an orthogonal complement spans the one below
            first = projector[:, np.argsort(-np.linalg.norm(projector, axis=0))]
            start = projector @ np.random.default_rng(n).standard_normal((n, above)) if above > 1 else first[:, :1]
            q, _ = np.linalg.qr(projector @ np.linalg.qr(start)[0], mode="complete")
            return q[:, :above], q[:, above:]
    return None


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling, and unit eigenvectors as columns) of symmetric ``v``."""
    v = (v + v.T) / 2
    parts, done = [np.eye(len(v))], []
    while parts:
        basis = parts.pop()
        inner = basis.T @ v @ basis
        two = _split((inner + inner.T) / 2) if basis.shape[1] > 1 else None
        if two is None:
            done.append(basis)
        else:
            parts += [basis @ two[0], basis @ two[1]]
    q = np.hstack(done)
    order = np.argsort(-np.einsum("ik,ij,jk->k", q, v, q), kind="stable")
    q = _polished(v, np.linalg.qr(q[:, order])[0])
    e = np.einsum("ik,ij,jk->k", q, v, q)
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


def _polished(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``q`` turned until ``q.T v q`` has nothing beside its diagonal: plane rotations on what division has left there."""
    a = q.T @ v @ q
    for _ in range(12):
        off = np.abs(np.triu(a, 1))
        rows, columns = np.nonzero(off > EPS * np.sqrt(np.abs(np.outer(np.diag(a), np.diag(a)))) + EPS * EPS * np.abs(a).max())
        if not len(rows):
            break
        for i, j in zip(rows, columns):
            if a[i, j] == 0:
                continue
            tau = (a[j, j] - a[i, i]) / (2 * a[i, j])
            t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            turn = np.array([[c, t * c], [-t * c, c]])
            q[:, [i, j]] = q[:, [i, j]] @ turn
            a[:, [i, j]] = a[:, [i, j]] @ turn
            a[[i, j], :] = turn.T @ a[[i, j], :]
    return q


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain; x is array<long>."""
    c = F.col("embedding").cast("array<double>")
    bound = F.lit(2.0**46)
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(c, lambda e: F.coalesce((e > -bound) & (e < bound), F.lit(False)))
    x = F.transform(c, lambda e: F.floor(e * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    rows = embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    d = lengths.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    return rows.where(F.size("x") == (d or 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _summed(rows: DataFrame, part, kind: str = "double") -> list:
    """The entries of the array that ``part`` makes of a matrix of rows, each added up over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                found = part(_matrix(batch.slice(lo, BLOCK)))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["k", "v"])

    found = rows.mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return [r["v"] for r in sorted(found, key=lambda r: r["k"])]


def _covariance(rows: DataFrame, n: int, centred) -> np.ndarray:
    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return c.T @ c

    flat = np.array(_summed(rows, products))
    return flat.reshape(int(len(flat) ** 0.5), -1) / n


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: as Python's integers where a long might not hold them."""
    if n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


class Whitening:
    """What a fit gives: n, the sums, components as columns, their variances and shares, and how far whitened rows are from unit covariance."""

    def __init__(self, n: int, sums: np.ndarray, vectors: np.ndarray, variances: np.ndarray, shares: np.ndarray):
        self.n, self.sums, self.vectors, self.variances, self.shares, self.identity_error = n, sums, vectors, variances, shares, 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (deviations(x, self.n, self.sums) / self.n).astype(float) @ self.vectors / np.sqrt(self.variances)

    def squared(self, x: np.ndarray) -> list[int | None]:
        dev = deviations(x, self.n, self.sums)
        if dev.dtype != object and float(np.abs(dev).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (dev * dev).sum(axis=1).tolist()
        found = (sum(int(e) * int(e) for e in row) for row in dev)
        return [s if s < 1 << 63 else None for s in found]


def fit(distinct: DataFrame, top: int = TOP) -> Whitening | None:
    """The whitening of the vectors of ``distinct`` (x); None without vectors."""
    n = distinct.count()
    if n == 0:
        return None
    # sums of upper and lower bits apart: no task's sum leaves a long
    halves = _summed(distinct, lambda x: np.concatenate([(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)]), "long")
    d = len(halves) // 2
    sums = [(halves[k] << 26) + halves[d + k] for k in range(d)]
    sums = np.array(sums, np.int64 if max(map(abs, sums)) < 1 << 62 else object)
    v = _covariance(distinct, n, lambda x: (deviations(x, n, sums) / n).astype(float))
    e, q = eigen(v)
    some = np.flatnonzero(e > d * 1e-14 * max(e[0], 0))[:top]
    model = Whitening(n, sums, q[:, some], e[some], e[some] / max(np.trace(v), np.finfo(float).tiny))
    if len(some):
        mean = np.array(_summed(distinct, lambda x: model.whiten(x).sum(axis=0))) / n
        again = _covariance(distinct, n, lambda x: model.whiten(x) - mean)
        model.identity_error = float(np.abs(again - np.eye(len(some))).max())
    return model


def whitened(embeddings: DataFrame, top: int = TOP) -> DataFrame:
    """A row for each remaining row of ``embeddings`` (vec_id, embedding) and component."""
    rows = quantised(embeddings)
    model = fit(written(rows.select("x").distinct()), top)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    sent = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.variances)
        for batch in batches:
            for lo in range(0, batch.num_rows if k else 0, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = _matrix(part)
                rows = len(x)
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n)),
                    pa.array(m.squared(x), pa.int64()).take(pa.array(each)), pa.array(m.whiten(x).ravel()), pa.array(np.tile(m.shares, rows)), pa.array(np.full(rows * k, m.identity_error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
