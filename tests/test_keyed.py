"""Streams with keyed state against their batch forms: cut anywhere, restarted, out of order, late, repeated."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corvine.operators import versions
from corvine.streaming import keyed

START = dt.datetime(2024, 1, 1)
EVENTS = "id long, key string, state string, ts timestamp"


def events(n, seed):
    rng, at, out = random.Random(seed), START, []
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, 5, 40, 90]))
        out.append((i, "hot" if i % 3 == 0 else f"k{rng.randrange(5)}", rng.choice(["a", "a", "b", None]), at))
    return out


def test_changes(spark, tmp_path):
    rows = spark.createDataFrame(events(200, 1), EVENTS)
    want = {tuple(r) for r in versions.changes(rows, "key", "state", "ts", "id").collect()}
    got, _ = keyed.replayed(keyed.slices(rows, "ts", 3), str(tmp_path), lambda s: keyed.changed(s, "key", "state", "ts", "id"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_changes_that_come_too_late(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    parts = [[(1, "k", "a", at(10)), (2, "k", "b", at(20)), (8, None, "x", at(1))], [(3, "k", "a", at(15)), (9, None, "x", at(2))], [(4, "k", "b", at(30)), (5, "k", "c", at(31))]]
    got, _ = keyed.replayed([spark.createDataFrame(p, EVENTS) for p in parts], str(tmp_path), lambda s: keyed.changed(s, "key", "state", "ts", "id"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 5, 8]


def test_debounce(spark, tmp_path):
    """Parts that overlap by less than the delay, in any order within; a last event closes all batches; one that comes after the watermark is dropped and counted."""
    rows, rng = events(300, 2), random.Random(4)
    late = sorted(rows, key=lambda r: (r[3] + dt.timedelta(seconds=rng.randrange(50)), r[0]))
    parts = [late[:120], late[120:200], late[200:]]
    for p in parts:
        rng.shuffle(p)
    end = (999, "end", None, rows[-1][3] + dt.timedelta(hours=3))
    frames = [spark.createDataFrame(p, EVENTS) for p in [*parts, [end], [(1000, "hot", "a", START)]]]
    got, queries = keyed.replayed(frames, str(tmp_path), lambda s: keyed.debounced(s, "key", "ts", 60, "2 minutes"))
    want = versions.debounced(spark.createDataFrame(rows, EVENTS), "key", "ts", 60)
    assert sorted(map(tuple, got.where("key <> 'end'").collect())) == sorted(map(tuple, want.collect()))
    assert [keyed.late_rows(q) for q in queries] == [0, 0, 0, 0, 1]


def test_upsert(spark, tmp_path):
    rows = spark.createDataFrame(events(200, 3), EVENTS)
    table = keyed.BucketTable(spark, f"file://{tmp_path}/table", rows.schema, "key", ("ts", "id"), 8)
    assert table.read().count() == 0
    parts = keyed.slices(rows, "ts", 3)
    for i in (2, 0, 1):  # in any order: the latest row of a key stays
        assert table.apply(parts[i], i)
    want = sorted(map(tuple, versions.latest(rows, "key", "ts", "id").collect()))
    assert sorted(map(tuple, table.read().select(rows.columns).collect())) == want
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    before = files()
    assert table.apply(parts[1], 1) == [] and files() == before  # it is in the table
    new = spark.createDataFrame([(900, "k1", "z", START + dt.timedelta(days=9))], EVENTS)
    (bucket,) = table.apply(new, 7)
    assert {p for p in before if f"bucket={bucket}/" not in p} == {p for p, t in files().items() if before.get(p) == t}  # other buckets stay as they are
    assert table.read().where("key = 'k1'").first().id == 900
    # a batch that failed after it had written, before it was marked
    (tmp_path / "table/_applied/main/7").unlink()
    assert table.apply(new, 7) == [bucket] and table.read().where(F.col("key") == "k1").count() == 1


def test_slices(spark):
    rows = spark.createDataFrame([*events(50, 5), (70, "k", "a", None)], EVENTS)
    parts = [p.collect() for p in keyed.slices(rows, "ts", 4)]
    assert sorted(r.id for p in parts for r in p) == [*range(50), 70] and len(parts) == 4
    assert all(max(r.ts for r in a if r.ts) < min(r.ts for r in b) for a, b in zip(parts[:-1], parts[1:], strict=True))


def test_changes_of_many_keys(spark, tmp_path):
    """A call into Python takes a bucket of keys; null keys and ids, and ids beyond what doubles hold, stay as they are in a bucket."""
    big, kinds = (1 << 60) + 1, "id long, key long, state string, ts timestamp, value double"
    at = lambda s: START + dt.timedelta(seconds=s)
    many = [(big + i, None if i % 50 == 0 else big + i % 1500, "ab"[i * 7 % 11 % 2], at(i), None if i % 3 else float("nan")) for i in range(4500)]
    rows = spark.createDataFrame([*many, (None, 5, None, at(9000), None), (None, 5, None, at(9001), 0.5), (big, 5, "a", None, 1.5)], kinds)
    got, queries = keyed.replayed(keyed.slices(rows, "ts", 2), str(tmp_path), lambda s: keyed.changed(s, "key", "state", "ts", "id"))
    want = versions.changes(rows, "key", "state", "ts", "id")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert 0 < queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"] <= keyed.BUCKETS


def test_silent_keys_are_forgotten(spark, tmp_path):
    """Two keys of one bucket: after the time of silence a repeated state is a change again."""
    at = lambda s: START + dt.timedelta(seconds=s)
    parts = [[(1, "k", "a", at(1)), (2, "l", "a", at(1))], [(3, "k", "a", at(2))]]
    frames = [spark.createDataFrame(p, EVENTS) for p in parts]
    for expiry, want in ((3_600_000, [1, 2]), (1, [1, 2, 3])):
        got, _ = keyed.replayed(frames, str(tmp_path / str(expiry)), lambda s, e=expiry: keyed.changed(s, "key", "state", "ts", "id", expiry_ms=e, buckets=1))
        assert sorted(r.id for r in got.collect()) == want


def test_debounce_of_many_keys(spark, tmp_path):
    """A call into Python takes a bucket of keys; keys beyond what doubles hold, and null, keep apart."""
    big = (1 << 60) + 1
    kinds = "key long, ts timestamp"
    many = [(None if i % 50 == 0 else big + i % 700, START + dt.timedelta(seconds=i * 7)) for i in range(4200)]
    rows = spark.createDataFrame([*many, (5, None)], kinds)
    end = spark.createDataFrame([(0, START + dt.timedelta(days=9))], kinds)
    got, queries = keyed.replayed([*keyed.slices(rows, "ts", 3), end], str(tmp_path), lambda s: keyed.debounced(s, "key", "ts", 6000, "1 minute"))
    got, want = got.where("not key <=> 0"), versions.debounced(rows, "key", "ts", 6000)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.where("n > 1 and batch > 0").count()
    assert 0 < queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"] <= keyed.BUCKETS
