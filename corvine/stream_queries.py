"""Registered queries of streams over given tables: the rows of their batch forms, by state, timers and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans.store import scratch
from .queries import DEBOUNCE_SECONDS, ORACLES, query, table
from .streaming import keyed

#: A stream stops after each of so many parts and goes on from its checkpoint.
PARTS, DELAY, BUCKETS = 3, "1 hour", 16


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(ORACLES["hash_change_events"])
def hash_change_stream(spark, sf_dir):
    """hash_change_events' rows from a stream with each user's last state."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    found, _ = keyed.replayed(keyed.slices(events, "ts", PARTS), scratch(spark), lambda s: keyed.changed(s, "user_id", "event_type", "ts", "event_id"))
    return found.select("event_id", "user_id", "event_type")


@query(ORACLES["debounce_batches"])
def debounce_stream(spark, sf_dir):
    """debounce_batches' rows from a stream: timers close a user's batches as the watermark passes. A last event, of the key `end` and far ahead, closes all."""
    events = _events(spark, sf_dir).where("user_id is not null").select(F.col("user_id").cast("string").alias("key"), "ts")
    ahead = F.expr(f"max(ts) + interval {2 * DEBOUNCE_SECONDS} seconds + interval {DELAY}")
    end = events.agg(F.lit("end").alias("key"), ahead.alias("ts"))
    found, _ = keyed.replayed([*keyed.slices(events, "ts", PARTS), end], scratch(spark), lambda s: keyed.debounced(s, "key", "ts", DEBOUNCE_SECONDS, DELAY))
    return found.where("key <> 'end'").select(F.col("key").cast("long").alias("user_id"), "batch", "batch_start_us", "n")


@query(ORACLES["latest_version"])
def upsert_stream(spark, sf_dir):
    """latest_version's rows from a stream that merges each batch into the hash buckets it touches; its last part comes twice."""
    events, folder = _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "ts"), scratch(spark)
    target = keyed.BucketTable(spark, f"{folder}/table", events.schema, "user_id", ("ts", "event_id"), BUCKETS)
    parts = keyed.slices(events, "ts", PARTS)
    for part in [*parts, parts[-1]]:
        part.write.mode("append").parquet(f"{folder}/in")
        keyed.upserting(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), target, f"{folder}/checkpoint").awaitTermination()
    return target.read().select("user_id", "event_id", "event_type", "value")
