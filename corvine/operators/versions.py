"""Changes over time: hash changes, latest versions, debounced batches, compaction triggers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_DEAD, DEAD_SHARE = 50, 0.2


def changes(deltas: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """Rows whose state differs from the one before of their key; a key's first row is a change."""
    w = Window.partitionBy(key).orderBy(*order)
    before = deltas.withColumn("_before", F.lag(state).over(w)).withColumn("_n", F.row_number().over(w))
    return before.where((F.col("_n") == 1) | ~F.col(state).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that comes last. One aggregate, combined before the shuffle, instead of a window."""
    best = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def _gathered(span: int):
    """From rows of key and time (microseconds), sorted by both, the batches of each key. A key's state is two numbers, whatever the number of its rows."""

    def run(batches):
        now, start, n, number = None, 0, 0, 0
        for batch in batches:
            keys, times, out = batch.column(0).to_pylist(), batch.column(1).to_numpy(), []
            cuts = np.flatnonzero([True, *(a != b for a, b in zip(keys[1:], keys[:-1], strict=True))]) if keys else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if n and keys[a] != now:
                    out.append((now, number, start, n))
                    n = 0
                if not n:
                    now, number, start = keys[a], 0, int(times[a])
                while a < b:
                    # What comes within the span of the batch's first event belongs to it.
                    stop = a + int(np.searchsorted(times[a:b], start + span))
                    n += stop - a
                    if stop < b:
                        out.append((now, number, start, n))
                        number, start, n = number + 1, int(times[stop]), 0
                    a = stop
            yield _batch_rows(batch, out)
        if n:
            yield _batch_rows(batch, [(now, number, start, n)])

    return run


def _batch_rows(like: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (like.schema.field(0).type, pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[like.schema.names[0], "batch", "batch_start_us", "n"])


def debounced(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """key, batch (from 0), batch_start_us and n: a batch takes what comes within `seconds` of its first event; later events don't prolong it. Null times are left out.

    Rows are dealt by key, sorted by time and scanned once.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).where("_us is not null")
    placed = rows.repartition(key).sortWithinPartitions(key, "_us")
    return placed.mapInArrow(_gathered(seconds * 1_000_000), f"`{key}` {kind}, batch long, batch_start_us long, n long")


def needs_compaction(dead: Column, total: Column) -> Column:
    return (dead > MOST_DEAD) | ((total > 0) & (dead > DEAD_SHARE * total))


def numbered(keys: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys with their place in sorted order, from 0: sorted by range, counted by partition, numbered within it."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.select(key).repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    # The id is the partition's number above 33 bits and the place in the partition below.
    placed = placed.select(key, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(key, (F.col("_before") + F.col("_at")).alias(name))
