"""Nearest neighbours from cells: k-means centres, a byte for each entry of what a vector differs from its centre, and exact re-ranking.

The centres are fitted on a bounded sample and number about the root of the rows; every row is indexed.
A row's code is its difference from the nearest centre in 255 steps of its own scale, and what the code
leaves out is stored as one number, the error's length, so the distance from a code is true to within
that number. Codes lie in lots by cell, a quarter of the vectors' bytes; a cell that holds many rows (a
third of them may be copies of one vector) is many lots, and their joins are salted.

A search sends each query to its nearest cells (as many as found 95 of 100 neighbours of a sample when
the index was built, or as given), scores codes there, and ranks the best of them again by their vectors.
The exact search goes on from there: the k-th distance found bounds what is still needed, so each query
visits all cells that the triangle inequality doesn't exclude, keeps the rows whose code's distance less
its error is within the bound, and ranks those by their vectors. Queries are rows, never a list.

Left out are null keys and vectors, and those with null or non-finite entries. Keys are unique; vectors
have one dimension. Ties, after rounding, go by key.
"""

from __future__ import annotations

import json
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import kept, scratch

#: Centres at most, rows of the sample for each, rounds of k-means, rows of a lot, lots that share a salt, queries of a block.
CELLS, SAMPLE_PER_CELL, ROUNDS, LOT, SALTED, BLOCK = 4096, 32, 8, 8192, 16, 1024
#: Codes that are ranked again, for each result; neighbours of the sample that the probed cells must hold, and how many of it ask.
AGAIN, HELD, ASKING = 8, 0.95, 256
#: Distances held at once: what a worker's memory for them follows, however many cells there are and however long batches are.
DISTANCES = 1 << 20
SLACK = 1e-6


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and vector, without nulls and entries that aren't finite."""
    finite = F.forall(column, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return vectors.where(F.col(key).isNotNull() & (F.size(column) > 0) & finite).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def slices(rows: int, others: int):
    """Ranges of rows whose distances to `others` are DISTANCES together, about."""
    step = max(1, DISTANCES // max(1, others))
    return ((i, min(i + step, rows)) for i in range(0, rows, step))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *(squared(x[a:b], centres).argmin(1) for a, b in slices(len(x), len(centres)))])


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """k-means centres; the first are rows of the sample, a centre that loses its rows stays where it was."""
    centres = sample[:cells].copy()
    for _ in range(ROUNDS if len(sample) else 0):
        near = nearest_centre(sample, centres)
        many = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[many > 0] = sums[many > 0] / many[many > 0, None]
    return centres.astype(np.float32).astype(np.float64)


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """Cells that a query has to visit for HELD of its nearest rows, by the first ASKING rows of the sample."""
    if len(sample) < 2:
        return 1
    asked, cell, visits = sample[:ASKING], nearest_centre(sample, centres), []
    for a, b in slices(len(asked), len(sample)):
        d2 = squared(asked[a:b], sample)
        d2[np.arange(b - a), np.arange(a, b)] = np.inf
        near = np.argsort(d2, axis=1)[:, : max(1, min(k, len(sample) - 1))]
        place = np.argsort(np.argsort(squared(asked[a:b], centres), axis=1), axis=1)
        visits.append(np.take_along_axis(place, cell[near], axis=1) + 1)
    return int(np.quantile(np.concatenate(visits), HELD, method="higher"))


def _coded(shared):
    """Of rows (id, vector): id, cell, code, scale and err, the length of what the code leaves out; and the distance to the centre."""

    def run(batches):
        centres = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            cell = nearest_centre(x, centres)
            rest = x - centres[cell]
            scale = (np.abs(rest).max(1) / 127).astype(np.float32)
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).clip(-127, 127).astype(np.int8)
            err = np.sqrt(((rest - code * scale[:, None].astype(np.float64)) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(err), pa.array(np.sqrt((rest * rest).sum(1)))], names=["id", "cell", "code", "scale", "err", "away"]
            )

    return run


def _lots(batches):
    """Of coded rows in order of cell and part, lots of both."""

    def lot(cell, part, rows):
        ids, code, scale, err = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "part": pa.array([part], pa.int32()), "ids": [np.array(ids, dtype=np.int64).tobytes()], "codes": [b"".join(code)], "scales": [np.array(scale, dtype=np.float32).tobytes()], "errs": [np.array(err).tobytes()]})

    now, held = None, []
    for batch in batches:
        for cell, part, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "id", "code", "scale", "err")), strict=True):
            if held and (now != (cell, part) or len(held) == LOT):
                yield lot(*now, held)
                held = []
            now = (cell, part)
            held.append(row)
    if held:
        yield lot(*now, held)


def _visits(shared, probes: int | None):
    """Of queries (id, vector, reach): the cells that each visits, the nearest `probes` of them or all within its reach, with the vector."""

    def run(batches):
        centres, radius = shared.value
        for batch in batches:
            if not len(batch):
                continue
            whole, wide = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in slices(len(whole), len(centres)):
                q, reach, ids = whole[a:b], wide[a:b], batch.column(0).slice(a, b - a)
                d = np.sqrt(squared(q, centres))
                if probes is None:
                    row, cell = np.nonzero(d - radius <= (reach + SLACK * (1 + d.max(1)))[:, None])
                else:
                    cell = np.argpartition(d, probes - 1, axis=1)[:, :probes].ravel()
                    row = np.repeat(np.arange(len(q)), min(probes, d.shape[1]))
                raw = [v.tobytes() for v in q]
                step = 1 << 14
                for i in range(0, len(row), step):
                    r = row[i : i + step]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + step].astype(np.int32)), ids.take(pa.array(r)), pa.array([raw[x] for x in r.tolist()], pa.binary()), pa.array(reach[r])], names=["cell", "qid", "q", "reach"])

    return run


def _blocks(batches):
    """Of visits in order of cell and salt, blocks of queries."""

    def block(cell, salt, rows):
        qid, q, reach = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "salt": pa.array([salt], pa.int32()), "qids": [np.array(qid, dtype=np.int64).tobytes()], "qs": [b"".join(q)], "reaches": [np.array(reach).tobytes()]})

    now, held = None, []
    for batch in batches:
        for cell, salt, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "salt", "qid", "q", "reach")), strict=True):
            if held and (now != (cell, salt) or len(held) == BLOCK):
                yield block(*now, held)
                held = []
            now = (cell, salt)
            held.append(row)
    if held:
        yield block(*now, held)


def _scored(shared, best: int | None):
    """Of pairs of a lot and a block of queries: qid, id and d, the `best` of each query by their codes, or all that its reach can't exclude."""

    def run(batches):
        centres, _ = shared.value
        for batch in batches:
            for cell, ids, codes, scales, errs, qids, qs, reaches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, qid = np.frombuffer(ids, dtype=np.int64), np.frombuffer(qids, dtype=np.int64)
                x = np.frombuffer(codes, dtype=np.int8).reshape(len(own), -1) * np.frombuffer(scales, dtype=np.float32).astype(np.float64)[:, None] + centres[cell]
                q = np.frombuffer(qs).reshape(len(qid), -1)
                reach, err = np.frombuffer(reaches), np.frombuffer(errs)
                for a, b in slices(len(qid), len(own)):
                    d = np.sqrt(squared(q[a:b], x))
                    if best is None:
                        r, at = np.nonzero(d <= reach[a:b, None] + err + SLACK * (1 + d))
                    else:
                        n = min(best, len(own))
                        at = np.argpartition(d, n - 1, axis=1)[:, :n].ravel()
                        r = np.repeat(np.arange(b - a), n)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[a:b][r]), pa.array(own[at]), pa.array(d[r, at])], names=["qid", "id", "d"])

    return run


class CellIndex:
    """<folder>/codes (cell, part, salt, ids, codes, scales, errs: lots), cells (cell, salts, radius), vectors (id, vector) and centres (one row)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        one = self.table("centres").first()
        self.probes, self.dim = one["probes"], one["dim"]
        self._centres = np.frombuffer(one["centres"]).reshape(-1, max(1, self.dim))

    @classmethod
    def build(cls, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", folder: str | None = None) -> CellIndex:
        spark = vectors.sparkSession
        folder = (folder or scratch(spark)).rstrip("/")
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows = usable(vectors, key, column)
        write(rows, "vectors")
        rows = spark.read.parquet(f"{folder}/vectors")
        n_cells = max(1, min(CELLS, isqrt(rows.count())))
        sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(n_cells * SAMPLE_PER_CELL).select("vector").toArrow().column(0))
        centres = fitted(sample, n_cells)
        meta = json.dumps({"probes": probes_needed(sample, centres), "dim": sample.shape[1] if len(sample) else 0})
        write(spark.createDataFrame([(json.loads(meta)["probes"], json.loads(meta)["dim"], centres.tobytes())], "probes int, dim int, centres binary"), "centres")
        shared = spark.sparkContext.broadcast(centres)  # CELLS centres at most
        coded = kept(rows.mapInArrow(_coded(shared), "id long, cell int, code binary, scale float, err double, away double"))
        sizes = coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        parts = sizes.select("cell", F.ceil(F.col("n") / LOT).cast("int").alias("parts"), "radius")
        write(parts.select("cell", F.ceil(F.col("parts") / SALTED).cast("int").alias("salts"), "radius"), "cells")
        placed = coded.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        lots = placed.repartition("cell", "part").sortWithinPartitions("cell", "part", "id").mapInArrow(_lots, "cell int, part int, ids binary, codes binary, scales binary, errs binary")
        write(lots.withColumn("salt", F.floor(F.col("part") / SALTED).cast("int")), "codes")
        return cls(spark, folder)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _candidates(self, queries: DataFrame, probes: int | None, best: int | None) -> DataFrame:
        """qid, id and d from codes, for queries of (id, vector, reach)."""
        if not self.dim:
            return self.spark.createDataFrame([], "qid long, id long, d double")
        radius = np.zeros(max(1, len(self._centres)))
        for r in self.table("cells").collect():  # CELLS at most
            radius[r.cell] = r.radius
        shared = self.spark.sparkContext.broadcast((self._centres, radius))
        probes = probes and min(probes, len(self._centres))
        visits = queries.select("id", "vector", "reach").mapInArrow(_visits(shared, probes), "cell int, qid long, q binary, reach double")
        salted = visits.join(F.broadcast(self.table("cells").select("cell", "salts")), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        blocks = salted.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "qid").mapInArrow(_blocks, "cell int, salt int, qids binary, qs binary, reaches binary")
        pairs = self.table("codes").join(blocks, ["cell", "salt"]).select("cell", "ids", "codes", "scales", "errs", "qids", "qs", "reaches")
        return pairs.mapInArrow(_scored(shared, best), "qid long, id long, d double")

    def _ranked(self, found: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
        """qid, id, d2 and rank of the k nearest of what was found, by the vectors themselves."""
        full = found.select("qid", "id").join(self.table("vectors"), "id").join(queries.select(F.col("id").alias("qid"), F.col("vector").alias("asked")), "qid")
        apart = F.zip_with("vector", "asked", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        d2 = full.select("qid", "id", F.round(F.aggregate(apart, F.lit(0.0), lambda s, e: s + e), digits).alias("d2"))
        return d2.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "id"))).where(F.col("rank") <= k)

    def nearest(self, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", probes: int | None = None, digits: int = 9) -> DataFrame:
        """qid, key, d2 and rank of about the k nearest rows to each query: those that its `probes` nearest cells hold."""
        asked = usable(queries, key, column).withColumn("reach", F.lit(0.0))
        found = self._candidates(asked, probes or self.probes, AGAIN * k)
        again = found.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "id"))).where(F.col("r") <= AGAIN * k)
        return self._ranked(again, asked, k, digits).withColumnRenamed("id", key)

    def nearest_exact(self, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", digits: int = 9) -> DataFrame:
        """The same of exactly the k nearest: the rows of comparing all."""
        asked = usable(queries, key, column)
        first = self.nearest(queries, k, key, column, probes=max(1, ceil(self.probes / 8)), digits=digits)
        bound = first.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.sqrt("d2").alias("reach"))
        bounded = kept(asked.join(bound, "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))))
        return self._ranked(self._candidates(bounded, None, None), bounded, k, digits).withColumnRenamed("id", key)
