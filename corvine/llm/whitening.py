"""Embedding whitening: a singular value decomposition by blockwise QR and plane rotations.

Vectors become whole numbers, and each distinct one is fitted once. Tasks centre their rows exactly (the
mean's whole part is taken off as integers, its fraction as a double) and compress them, block by block,
to a triangle R; triangles are stacked and compressed again in groups, until one is left, whose size is
the dimension, whatever the number of rows. On the driver plane rotations make its columns orthogonal
(one-sided Jacobi); the accumulated rotations are the components, the columns' lengths the standard
deviations, small ones as accurate as large ones, since no covariance matrix is ever formed. Another pass
over the fit list measures how far the whitened rows are from unit covariance.

Cases: vectors that are null, or hold null or non-finite entries, or entries of 2**53 / SCALE or more,
are left out, and so are those whose dimension isn't that of most rows; equal vectors count once in the
fit, and each row is whitened; rows that repeat, or have no key, are whitened one by one; directions
without variance (constant entries, fewer rows than entries) have no component, so a table of one
distinct vector, or none, gives no rows; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_ranges, durable, in_python, table
from .vectors import quantised, unpack

#: Entries become floor(SCALE * entry). An offset added to each, as in some definitions of this list, cancels out in all results.
SCALE = 64
MOST = 16
#: Rows that a task compresses at once, and triangles that are compressed together.
BLOCK, FAN = 4096, 16
SWEEPS = 60


@dataclass
class Whitening:
    """n and sums of the fit list, components as columns, their variances and shares of all variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - sum) ** 2 of each row, exact."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if largest * largest * x.shape[1] < 1 << 63:
            away = self.n * x - np.array(self.sums, dtype=np.int64)
            return (away * away).sum(1).tolist()
        found = [sum((self.n * e - s) ** 2 for e, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in found]


def rotations(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi: lengths of the columns of r once they are orthogonal, descending, and the rotation that made them so.

    A sweep pairs each column with each other, half of them at a time; it is the last if all pairs were orthogonal.
    """
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    ring = list(range(d + d % 2))  # a place beyond the columns rests its partner
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(1, len(ring) - 1)):
            half = len(ring) // 2
            pairs = [(p, q) for p, q in zip(ring[:half], ring[half:][::-1], strict=True) if p < d and q < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            skew = np.abs(gamma) > np.finfo(float).eps * d * np.sqrt(alpha * beta)
            if not skew.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[skew], q[skew], alpha[skew], beta[skew], gamma[skew]
            with np.errstate(over="ignore"):  # an angle of nothing then
                zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    length = np.sqrt((a * a).sum(0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:, order]


def _triangle(blocks, dim: int) -> np.ndarray:
    r = np.zeros((0, dim))
    for block in blocks:
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    return r


def _triangle_row(at: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["at", "r"])


def _compressed(mean: Whitening, dim: int):
    """Of a task's rows one triangle."""

    def blocks(batches):
        for batch in batches:
            x = unpack(batch.column(0), dim)
            for i in range(0, len(x), BLOCK):
                yield mean.centred(x[i : i + BLOCK])

    def run(batches):
        r = _triangle(blocks(batches), dim)
        if len(r):
            yield _triangle_row(TaskContext.get().partitionId(), r)

    return run


def _stacked(dim: int):
    """Of triangles sorted by their group one triangle a group."""

    def run(batches):
        at, r = None, np.zeros((0, dim))
        for batch in batches:
            for group, raw in zip(batch.column("at").to_pylist(), batch.column("r").to_pylist(), strict=True):
                if at is not None and group != at:
                    yield _triangle_row(at, r)
                    r = np.zeros((0, dim))
                at, r = group, _triangle([r, np.frombuffer(raw).reshape(-1, dim)], dim)
        if at is not None:
            yield _triangle_row(at, r)

    return run


def triangle(rows: DataFrame, mean: Whitening, dim: int) -> np.ndarray:
    """R of the centred rows: a task's rows, then FAN triangles at a time, leave one."""
    found = durable(rows.select("x").transform(in_python, _compressed(mean, dim), "at long, r binary"))
    while found.count() > 1:
        grouped = by_ranges(found.withColumn("at", F.floor(F.col("at") / FAN)), "at")
        found = durable(grouped.transform(in_python, _stacked(dim), "at long, r binary"))
    return np.frombuffer(found.first()["r"]).reshape(-1, dim)


def _summed(rows: DataFrame, run, schema: str, *keys: str) -> list:
    """Sums of what tasks found, by keys; a bounded number of rows a task, combined before and after the shuffle."""
    s = F.col("s").cast("decimal(38,0)") if "s string" in schema else F.col("s")  # whole sums may be beyond 64 bits
    return rows.transform(in_python, run, schema).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(s).alias("s")).collect()


def _column_sums(dim: int):
    def run(batches):
        n, sums = 0, [0] * dim
        for batch in batches:
            x = unpack(batch.column(0), dim)
            n += len(x)
            exact = int(np.abs(x).max(initial=0)) * len(x) < 1 << 63
            sums = [a + b for a, b in zip(sums, x.sum(0).tolist() if exact else map(sum, x.T.tolist()), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "s": pa.array([str(s) for s in sums], pa.string())})

    return run


def _products(model: Whitening, dim: int):
    """Sums of products of whitened entries; those of an entry alone have j = -1."""

    def run(batches):
        k = len(model.variances)
        i, j = np.tril_indices(k)
        n, products, alone = 0, np.zeros(len(i)), np.zeros(k)
        for batch in batches:
            w = model.whitened(unpack(batch.column(0), dim))
            n += len(w)
            products += (w.T @ w)[i, j]
            alone += w.sum(0)
        if n:
            at = pa.array(np.concatenate([i, np.arange(k)]), pa.int32()), pa.array(np.concatenate([j, np.full(k, -1)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*at, pa.array([n] * (len(i) + k), pa.int64()), pa.array(np.concatenate([products, alone]))], names=["i", "j", "n", "s"])

    return run


def fit(rows: DataFrame, dim: int, most: int = MOST) -> Whitening | None:
    """From packed vectors x of one dimension; None where nothing varies."""
    listed = durable(rows.select("x").distinct())
    found = {r.i: r for r in _summed(listed.select("x"), _column_sums(dim), "i int, n long, s string", "i")} if dim else {}
    if not found:
        return None
    model = Whitening(found[0].n, [int(found[i].s) for i in range(dim)], np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    length, v = rotations(triangle(listed, model, dim))
    real = length > length[0] * dim * np.finfo(float).eps if len(length) else np.zeros(0, dtype=bool)
    if not real.any():
        return None
    variances = length**2 / model.n
    kept = np.flatnonzero(real)[:most]
    largest = np.abs(v[:, kept]).argmax(0)
    model.components = v[:, kept] * np.where(v[largest, kept] < 0, -1.0, 1.0)
    model.variances, model.explained = variances[kept], variances[kept] / variances.sum()
    sums = {(r.i, r.j): r.s / r.n for r in _summed(listed.select("x"), _products(model, dim), "i int, j int, n long, s double", "i", "j")}
    model.identity_error = max(abs(s - sums[i, -1] * sums[j, -1] - (i == j)) for (i, j), s in sums.items() if j >= 0)
    return model


def whiten(rows: DataFrame, model: Whitening, dim: int, key: str) -> DataFrame:
    """key, deviation and whitened, an entry for each component."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = unpack(batch.column(1), dim)
            w = model.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(x), pa.int64()), lists], names=[key, "deviation", "whitened"])

    return rows.select(key, "x").transform(in_python, run, f"`{key}` {kind}, deviation long, whitened array<double>")


def components(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = MOST) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error: a row for each usable row of `vectors` and component."""
    rows, dim = quantised(vectors, column, SCALE, key)
    model = fit(rows, dim, most)
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    each = whiten(rows, model, dim, key).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e)) for e in model.explained])
    return each.select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "embeddings"))
