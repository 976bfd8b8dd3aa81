"""Keyed state in streams: changes of a key's state, debounced batches by event time, idempotent upserts.

State is kept in Spark's state store and moves with the checkpoint, so a stopped or failed query goes on
where it was. What a key's state holds is bounded: its last value; the times of events that may still be
joined by others; nothing for upserts, whose state is the table. Keys are grouped by hash into buckets, whose
rows are worked on as arrays: a call into Python costs far more than a key's rows. A batch rewrites the buckets
that it touches, and a bucket's rows of one batch are in memory together, so many more keys want more buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DecimalType, FractionalType, IntegerType, IntegralType, LongType, StructField, StructType, TimestampType

from ..operators.versions import latest
from ..plans.store import kept

#: State lies on the executors' disks.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Groups of keys in a stream's state.
BUCKETS = 512


def _sent(fields: list[StructField]) -> tuple[list[Column], list[Column]]:
    """Columns `_<i>` as pandas holds them without loss, nulls of numbers and times apart as `_<i>n`; and what makes `fields` of them again."""
    out, back = [], []
    for i, f in enumerate(fields):
        c, kind, name = F.col("`" + f.name.replace("`", "``") + "`"), f.dataType, f"_{i}"
        if isinstance(kind, TimestampType):
            value, restored = F.unix_micros(c), F.timestamp_micros(name)
        elif isinstance(kind, IntegralType):
            value, restored = c, F.col(name)
        elif isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
            value, restored = c, F.coalesce(name, F.lit(float("nan")).cast(kind))  # NaN comes back as null
        else:
            out, back = [*out, c.alias(name)], [*back, F.col(name).alias(f.name)]
            continue
        zero = F.lit(0) if isinstance(kind, TimestampType) else F.lit(0).cast(kind)
        out += [F.coalesce(value, zero).alias(name), c.isNull().alias(f"{name}n")]
        back.append(F.when(~F.col(f"{name}n"), restored).alias(f.name))
    return out, back


def _of(rows: pd.DataFrame | list[str], i: int) -> list[str]:
    return [c for c in (f"_{i}", f"_{i}n") if c in rows]


def _codes(*tables: pd.DataFrame) -> list[np.ndarray]:
    """A number for each distinct row of all tables, from 0; null equals null."""
    found = pd.concat(tables, ignore_index=True)
    codes = found.groupby([*found.columns], sort=False, dropna=False).ngroup().to_numpy()
    return np.split(codes, np.cumsum([len(t) for t in tables])[:-1])


def _packed(rows: pd.DataFrame) -> bytes:
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(packed) as rows:
        return rows.read_pandas()


def _ranks(rows: pd.DataFrame, i: int) -> list[np.ndarray]:
    """What sorts rows by column i, nulls first, from its last key to its first as lexsort takes them."""
    if f"_{i}n" in rows:
        return [rows[f"_{i}"].to_numpy(), ~rows[f"_{i}n"].to_numpy(dtype=bool)]
    return [pd.factorize(rows[f"_{i}"], sort=True)[0]]


def _last_states(key: int, state: int, order: list[int], names: list[str], expiry_ms: int | None):
    """Rows whose state differs from the last one of their key. A group's state is a table of its keys: key, state, time, and when it was written."""

    def run(_, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        now = group.getCurrentProcessingTimeMs()
        last = _unpacked(group.get[0]) if group.exists else None
        if last is not None and expiry_ms:
            last = last[last["_seen"] + expiry_ms > now]
        if last is not None and not len(last):
            last = None
        new = pd.concat(parts, ignore_index=True)
        new["_seen"] = now
        ids, states = _of(names, key), _of(names, state)
        held = new.iloc[:0] if last is None else last
        known, codes = _codes(held[ids], new[ids]) if len(held) else (np.empty(0, dtype=np.int64), *_codes(new[ids]))
        before, after = _codes(held[states], new[states]) if len(held) else (known, *_codes(new[states]))
        at = np.full(1 + max(codes.max(), known.max(initial=0)), -1)
        at[known] = np.arange(len(known))
        times = new["_us"].to_numpy()
        if len(held):
            late = (at[codes] >= 0) & (times < held["_us"].to_numpy()[at[codes]])
            new, codes, after, times = new[~late], codes[~late], after[~late], times[~late]
        if not len(new):
            return
        placed = np.lexsort([*(r for i in reversed(order) for r in _ranks(new, i)), times, codes])
        new, codes, after = new.iloc[placed], codes[placed], after[placed]
        first = np.r_[True, codes[1:] != codes[:-1]]
        changed = np.r_[True, after[1:] != after[:-1]] | first
        old = first & (at[codes] >= 0)
        changed[old] = before[at[codes[old]]] != after[old]
        ends = new[np.r_[first[1:], True]][[*dict.fromkeys([*ids, *states]), "_us", "_seen"]]
        silent = ~np.isin(known, codes)
        group.update((_packed(pd.concat([last[silent], ends]) if silent.any() else ends),))
        yield new[names][changed]

    return run


def changed(stream: DataFrame, key: str, state: str, ts: str, *order: str, expiry_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a stream whose `state` differs from the one before of their key, in order of ts, then `order`; a key's first row is a change.

    The same rows as `versions.changes` gives of a table, whatever the stream is cut into, if later batches are not
    older. A row older than its key's last one comes too late to tell a change and is left out. A key that is silent
    for expiry_ms of processing time is forgotten, its place with the next row of its bucket; without it none is. Null times come before all others. `buckets`
    stays as it is for a checkpoint.
    """
    fields, place = stream.schema.fields, stream.columns.index
    sent, back = _sent(fields)
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62))).alias("_us")
    rows = stream.select(_bucket(key, buckets), *sent, us)
    kinds = StructType([StructField(f.name, f.dataType) for f in rows.schema if f.name not in ("_bucket", "_us")])
    run = _last_states(place(key), place(state), [place(o) for o in order], kinds.names, expiry_ms)
    return rows.groupBy("_bucket").applyInPandasWithState(run, kinds, "last binary", "append", GroupStateTimeout.NoTimeout).select(*back)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")


def _batches(span: int, key: list[str], names: list[str]):
    """Batches of a bucket's keys: each takes what comes within the span of its first event, and is closed once the watermark has passed its end. State: numbers of keys that had batches, and times that aren't closed."""

    def run(_, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        counts, rows = (_unpacked(p) for p in group.get) if group.exists else (None, None)
        new = [p[[*key, "_us"]] for p in parts if len(p)]
        rows = pd.concat([*([] if rows is None or not len(rows) else [rows]), *new], ignore_index=True)
        if not len(rows):
            return
        counted = counts is not None and len(counts)
        known, codes = _codes(counts[key], rows[key]) if counted else (np.empty(0, dtype=np.int64), *_codes(rows[key]))
        number = np.zeros(1 + max(codes.max(), known.max(initial=0)), dtype=np.int64)
        number[known] = counts["_number"].to_numpy() if counted else 0
        placed = np.lexsort((rows["_us"].to_numpy(), codes))
        rows, codes, until = rows.iloc[placed], codes[placed], group.getCurrentWatermarkMs() * 1000
        times = rows["_us"].to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist()
        due, heads, sizes, numbers, left, ends = (times + span <= until).tolist(), [], [], [], np.ones(len(rows), dtype=bool), []
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            if due[a]:
                i, n, key_times = a, int(number[codes[a]]), times[a:b]
                after = (a + np.searchsorted(key_times, key_times + span)).tolist()
                while i < b and due[i]:
                    heads.append(i)
                    sizes.append(after[i - a] - i)
                    numbers.append(n)
                    i, n = after[i - a], n + 1
                number[codes[a]], left[a:i] = n, False
                if i == b:
                    continue
                a = i
            ends.append(int(times[a]) + span)
        closed = rows.iloc[heads]
        ids = pd.concat([counts[key], rows[key]]) if counted else rows[key]
        of, at = np.unique(np.r_[known, codes], return_index=True)
        counts = ids.iloc[at].assign(_number=number[of])[number[of] > 0]
        group.update((_packed(counts), _packed(rows[left])))
        if ends:  # fires when the watermark is above
            group.setTimeoutTimestamp(max(1, -(-min(ends) // 1000) - 1))
        if heads:
            yield pd.DataFrame({**{k: closed[k].to_numpy() for k in key}, "batch": numbers, "batch_start_us": times[heads], "n": sizes})[names]

    return run


def debounced(stream: DataFrame, key: str, ts: str, seconds: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """key, batch (from 0), batch_start_us and n, a row for each batch as the watermark passes its end; `versions.debounced` of a stream.

    delay: how much later than the newest event one may come, in any order; what comes later than that is dropped by
    the watermark, and counted in the query's progress (`late_rows`). Null times are left out. State holds the times
    of what isn't closed and a number for each key. `buckets` stays as it is for a checkpoint.
    """
    sent, back = _sent([stream.schema[key]])
    time = F.col(ts).cast("timestamp")
    rows = stream.where(time.isNotNull()).select(_bucket(key, buckets), *sent, time.alias("_ts"), F.unix_micros(time).alias("_us")).withWatermark("_ts", delay)
    found = [StructField(f.name, f.dataType) for f in rows.schema if f.name not in ("_bucket", "_ts", "_us")]
    kinds = StructType([*found, *(StructField(n, LongType()) for n in ("batch", "batch_start_us", "n"))])
    run = _batches(seconds * 1_000_000, [f.name for f in found], kinds.names)
    batches = rows.groupBy("_bucket").applyInPandasWithState(run, kinds, "counts binary, open binary", "append", GroupStateTimeout.EventTimeTimeout)
    return batches.select(*back, "batch", "batch_start_us", "n")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, in the batches that the query's progress still tells of."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


class BucketTable:
    """<root>/bucket=<n>: a row for each key, the latest; and <root>/_applied/<batch>, the batches that are in it, by stream."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, order: tuple[str, ...], buckets: int):
        self.spark, self.root, self.schema, self.key, self.order, self.buckets = spark, root.rstrip("/"), schema, key, order, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _stored(self) -> DataFrame:
        whole = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        known = self._fs.exists(self._path(self.root))
        return self.spark.read.schema(whole).parquet(self.root) if known else self.spark.createDataFrame([], whole)

    def apply(self, rows: DataFrame, batch: int, stream: str = "main") -> list[int]:
        """Merges a batch into the buckets that it touches and returns these; a batch that is in the table changes nothing.

        The latest row of a key stays, so a batch that failed on its way, and left some of its buckets written, can be applied again.
        """
        mark = self._path(f"{self.root}/_applied/{stream}/{batch}")
        if self._fs.exists(mark):
            return []
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = kept(latest(rows, self.key, *self.order).withColumn("bucket", bucket))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if touched:
            merged = kept(latest(self._stored().where(F.col("bucket").isin(touched)).select(new.columns).unionByName(new), self.key, *self.order))
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.root)
        self._fs.create(mark, True).close()
        return touched


def upserting(stream: DataFrame, table: BucketTable, checkpoint: str, name: str = "main", **trigger) -> StreamingQuery:
    """Starts a stream that keeps the latest row of each key in `table`, batch by batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda rows, batch: table.apply(rows, batch, name) and None).trigger(**(trigger or {"availableNow": True})).start()


def run_to_end(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what there is and appends its rows to `out`; again, it goes on from its checkpoint."""
    spark = result.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def slices(rows: DataFrame, ts: str, n: int) -> list[DataFrame]:
    """`rows` in n parts by time, of about the same size."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = sorted(set(rows.select(us.cast("double").alias("us")).approxQuantile("us", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    edges = [None, *cuts, None]
    inside = lambda low, high: (F.lit(True) if low is None else us >= low) & (F.lit(True) if high is None else us < high)
    return [rows.where(F.coalesce(inside(a, b), F.lit(a is None))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def replayed(parts: list[DataFrame], folder: str, result: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[StreamingQuery]]:
    """What a stream gives of parts that arrive one after another, stopped after each and started again from its checkpoint."""
    spark, queries = parts[0].sparkSession, []
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        queries.append(run_to_end(result(spark.readStream.schema(part.schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out"), queries
