"""Vector columns as packed integers, one binary value a vector.

A packed vector is a byte that tells how many bytes an entry takes (1, 2, 4 or 8, the fewest that hold
all of them) and the entries, little-endian. Equal vectors are packed alike, so packed ones can be
compared, grouped and joined as they are, and shuffles carry a quarter of what floats take or less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, in_python, is_void

#: Entries of this size or more aren't whole numbers that doubles hold.
BEYOND = 1 << 53
WIDTHS = (1, 2, 4, 8)


def _binary(data: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as binary values."""
    n, size = data.shape
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * size), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def pack(matrix: np.ndarray) -> pa.Array:
    """Rows of an integer matrix, packed."""
    n = len(matrix)
    largest = np.maximum(matrix.max(1), -1 - matrix.min(1)) if matrix.shape[1] else np.zeros(n, dtype=np.int64)
    width = np.select([largest < 1 << 7, largest < 1 << 15, largest < 1 << 31], [1, 2, 4], 8)
    parts, places = [], []
    for w in WIDTHS:
        at = np.flatnonzero(width == w)
        if len(at):
            body = np.ascontiguousarray(matrix[at].astype(f"<i{w}")).view(np.uint8).reshape(len(at), -1)
            parts.append(_binary(np.concatenate([np.full((len(at), 1), w, dtype=np.uint8), body], axis=1)))
            places.append(at)
    if not parts:
        return pa.array([], pa.binary())
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places), kind="stable")))


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The integer matrix of packed vectors of one dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.empty((len(column), dim), dtype=np.int64)
    if not len(column):
        return out
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    width = data[offsets[:-1]]
    for w in WIDTHS:
        at = np.flatnonzero(width == w)
        if len(at):
            body = data[offsets[at][:, None] + 1 + np.arange(dim * w)]
            out[at] = np.ascontiguousarray(body).view(f"<i{w}").reshape(len(at), dim)
    return out


def _quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of usable vectors, their dimensions, and floor(scale * entry) of them, packed."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.cast(pc.list_flatten(column), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    whole = np.floor(scale * flat)
    bad = np.concatenate(([0], np.cumsum(~(np.abs(whole) < BEYOND))))  # not a number isn't smaller either
    usable = (lengths > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    rows, dims, parts = [], [], []
    for size in np.unique(lengths[usable]).tolist():
        at = np.flatnonzero(usable & (lengths == size))
        rows.append(at)
        dims.append(np.full(len(at), size, dtype=np.int32))
        parts.append(pack(whole[starts[at][:, None] + np.arange(size)].astype(np.int64)))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), pa.array([], pa.binary())
    return np.concatenate(rows), np.concatenate(dims), pa.concat_arrays(parts)


def quantised(vectors: DataFrame, column: str, scale: int, *keep: str) -> tuple[DataFrame, int]:
    """The columns of `keep` and x, floor(scale * entry) of each entry, packed; and x's dimension, 0 if there are no rows.

    Left out are null vectors and those with a null or non-finite entry, or one that isn't below 2**53 once
    scaled. The dimension is that of most rows, of equally many the larger; rows of others are left out.
    The rows are written down once, as all that follows reads them again.
    """
    kinds = vectors.select(*keep).schema

    def run(batches):
        for batch in batches:
            at, dims, x = _quantised(batch.column(len(keep)), scale)
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(place) for i in range(len(keep))], pa.array(dims), x], names=[*keep, "dim", "x"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kinds) + "dim int, x binary"
    packed = durable(vectors.select(*keep, column).transform(in_python, run, schema))
    dims = packed.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    return (packed, 0) if dims is None else (packed.where(F.col("dim") == dims["dim"]).drop("dim"), dims["dim"])


def one_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows that share a key the one that is largest by `order`. Only keys are shuffled, and the rows of those that repeat."""
    again = durable(rows.groupBy(key).count().where("count > 1").select(key))
    if is_void(again):
        return rows
    best = rows.join(again, key, "left_semi").groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_best")).select("_best.*")
    return rows.join(again, key, "left_anti").unionByName(best)
