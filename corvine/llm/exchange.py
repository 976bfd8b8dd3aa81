"""Who has a key first? A packed exchange of 64-bit keys between documents, by ranges of keys.

Each task sorts the keys of a batch of documents, settles in the batch what the batch can settle,
and sends one entry for each key on: so a key that a third of all documents hold costs an entry a
batch, not one a document. Entries travel as compact binary columns, one row for each batch and
range of keys. A task that holds a range adds its batches to a logarithmic family of sorted arrays:
a new batch is merge-scanned against all levels, then becomes a level itself, and levels of about
equal size merge, so that each entry is merged a logarithmic number of times. What the ranges found
goes to the documents again, one row for each document. All steps are pure functions of their rows:
a lost executor's part can be run again anywhere, and nothing depends on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import by_ranges, in_python, width

LATER, SHARED = 1, 2
ENTRIES = "range int, kind int, key binary, check binary, doc binary, ord binary, many binary"
FOUND = "bucket int, doc binary, ord binary, flag binary"
_NONE = np.zeros(0, dtype=np.int64)


def pack(a: np.ndarray) -> bytes:
    """Byte planes, so that what sorted or small numbers have in common lies together for the shuffle's compression."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """First places of runs of equal rows."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def bucket_of(doc: np.ndarray, n: int) -> np.ndarray:
    x = doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def entries(key: np.ndarray, check: np.ndarray, doc: np.ndarray, ord_: np.ndarray, n_ranges: int, n_buckets: int, within: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRIES from the entries of one batch. kind 0 goes to the key's range, kind 1 is settled.

    within: a document's later entry with a key that it already had counts as later, too.
    """
    order = bs.order_by(key, check, doc, ord_)
    key, check, doc, ord_ = key[order], check[order], doc[order], ord_[order]
    first = runs_of(key, check)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    lead = doc == doc[first][group]
    if within:
        later = np.ones(len(key), dtype=bool)
        later[first] = False
    else:
        later = ~lead
    several = np.zeros(len(first), dtype=bool)
    several[group[later]] = True
    shared = several[group]
    settled = np.flatnonzero(later | shared)
    if len(settled):
        yield from settled_rows(doc[settled], ord_[settled], (later[settled] * LATER + shared[settled] * SHARED).astype(np.uint8), n_buckets)
    sent = np.flatnonzero(lead & ~later)
    key, check, doc, ord_ = key[sent], check[sent], doc[sent], ord_[sent]
    first = runs_of(key, check)
    many = np.diff(np.append(first, len(key)))
    place = (key[first] >> np.uint64(32)).astype(np.uint64) * np.uint64(n_ranges) >> np.uint64(32)
    starts = np.append(runs_of(place), len(first))
    ends = np.append(first, len(key))
    rows = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        x, y = ends[a], ends[b]
        one = bool((many[a:b] == 1).all())
        rows.append((int(place[a]), 0, pack(key[first[a:b]]), pack(check[first[a:b]]), pack(doc[first[a:b]]), pack(ord_[x:y].astype(np.uint32)), b"" if one else pack(many[a:b].astype(np.uint32))))
    yield _table(rows, ("range", "kind", "key", "check", "doc", "ord", "many"))


def settled_rows(doc, ord_, flag, n_buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = bucket_of(doc, n_buckets)
    order = np.argsort(bucket, kind="stable")
    starts = np.append(runs_of(bucket[order]), len(order))
    rows = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        at = order[a:b]
        rows.append((int(bucket[at[0]]), 1, b"", flag[at].tobytes(), pack(doc[at]), pack(ord_[at].astype(np.uint32)), b""))
    yield _table(rows, ("range", "kind", "key", "check", "doc", "ord", "many"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"range": pa.int32(), "kind": pa.int32(), "bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.binary())) for i, n in enumerate(names)], names=list(names))


class Family:
    """A logarithmic family of sorted arrays of keys, each key with the smallest document that has it.

    Added entries get slots 0, 1, ... and `flags` says of each slot whether a smaller document has its key, and whether any other has.
    """

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []  # key, check, doc, slot; keys are unique over all levels
        self.odd: dict[tuple[int, int], tuple[int, int]] = {}  # entries whose key is taken by another check
        self.flags = np.zeros(1024, dtype=np.uint8)
        self.slots = 0

    def add(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> None:
        """key ascending, (key, check) without repetition."""
        base, n = self.slots, len(key)
        self.slots += n
        if self.slots > len(self.flags):
            self.flags = np.concatenate((self.flags, np.zeros(max(len(self.flags), n), dtype=np.uint8)))
        free = np.ones(n, dtype=bool)
        if n:
            free[1:] = key[1:] != key[:-1]
        clash = set(np.flatnonzero(~free).tolist())
        for level in self.levels:
            keys, checks, docs, slots = level
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            same = np.flatnonzero((keys[at] == key) & free) if len(keys) else _NONE
            if not len(same):
                continue
            free[same] = False
            fit = checks[at[same]] == check[same]
            clash.update(same[~fit].tolist())
            same = same[fit]
            there = at[same]
            older = docs[there] < doc[same]
            self.flags[base + same] |= np.where(older, LATER | SHARED, SHARED).astype(np.uint8)
            self.flags[slots[there]] |= np.where(older, SHARED, LATER | SHARED).astype(np.uint8)
            won = same[~older]
            docs[there[~older]], slots[there[~older]] = doc[won], base + won
        for i in clash:
            self._single(key[i], int(check[i]), int(doc[i]), base + i)
        new = np.flatnonzero(free)
        if len(new):
            self.levels.append([key[new], check[new], doc[new].copy(), base + new])
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            both = [np.concatenate((x, y)) for x, y in zip(b, a, strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append([x[order] for x in both])

    def _single(self, key: np.uint64, check: int, doc: int, slot: int) -> None:
        """An entry whose key came with another check, too: its own may be in a level all the same."""
        for keys, checks, docs, slots in self.levels:
            at = int(np.searchsorted(keys, key))
            if at < len(keys) and keys[at] == key:
                if int(checks[at]) != check:
                    break
                older = docs[at] < doc
                self.flags[slot] |= (LATER if older else 0) | SHARED
                self.flags[slots[at]] |= (0 if older else LATER) | SHARED
                if not older:
                    docs[at], slots[at] = doc, slot
                return
        self._odd(int(key), check, doc, slot)

    def _odd(self, key: int, check: int, doc: int, slot: int) -> None:
        found = self.odd.get((key, check))
        # Arrays hold one check of each key, the first that came; entries with any other check of it are all here.
        if found is None:
            self.odd[key, check] = doc, slot
            return
        other, its = found
        self.flags[slot] |= (LATER if other < doc else 0) | SHARED
        self.flags[its] |= (LATER if doc < other else 0) | SHARED
        if doc < other:
            self.odd[key, check] = doc, slot


class Outbox:
    """Flagged entries on their way to the documents' buckets, sent a lot at a time: few rows, whatever the number of ranges."""

    def __init__(self, n_buckets: int, size: int = 1 << 20):
        self.n_buckets, self.size, self.held, self.n = n_buckets, size, [], 0

    def put(self, doc: np.ndarray, ord_: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(doc):
            self.held.append((doc, ord_, flag))
            self.n += len(doc)
        if self.n >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            doc, ord_, flag = (np.concatenate([h[i] for h in self.held]) for i in range(3))
            self.held, self.n = [], 0
            for rows in settled_rows(doc, ord_, flag, self.n_buckets):
                yield to_bucket(rows)


def _ranges(n_buckets: int, wanted: int) -> Callable:
    """From rows of ENTRIES, sorted by kind and range, rows of FOUND: entries with a flag that is wanted."""

    def judged(family: Family, docs: list, ords: list, manys: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = np.concatenate(manys)
        flag = np.repeat(family.flags[: family.slots], many)
        at = np.flatnonzero(flag & wanted)
        return np.repeat(np.concatenate(docs), many)[at], np.concatenate(ords)[at], flag[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outbox(n_buckets)
        now, family, docs, ords, manys = None, Family(), [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"]:
                    flag = np.frombuffer(r["check"], dtype=np.uint8)
                    at = np.flatnonzero(flag & wanted)
                    yield from out.put(unpack(r["doc"], np.int64)[at], unpack(r["ord"], np.uint32)[at], flag[at])
                    continue
                if r["range"] != now:
                    if docs:
                        yield from out.put(*judged(family, docs, ords, manys))
                    now, family, docs, ords, manys = r["range"], Family(), [], [], []
                key, check, doc = unpack(r["key"], np.uint64), unpack(r["check"], np.uint32), unpack(r["doc"], np.int64)
                family.add(key, check, doc)
                docs.append(doc)
                ords.append(unpack(r["ord"], np.uint32))
                manys.append(unpack(r["many"], np.uint32).astype(np.int64) if r["many"] else np.ones(len(doc), dtype=np.int64))
        if docs:
            yield from out.put(*judged(family, docs, ords, manys))
        yield from out.flush()

    return run


def to_bucket(rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(4), rows.column(5), rows.column(3)], names=["bucket", "doc", "ord", "flag"])


def by_document(found: DataFrame) -> DataFrame:
    """From rows of FOUND doc_id, ords (uint32, ascending) and flags (uint8, the largest of each ordinal)."""
    return by_ranges(found, "bucket").transform(in_python, _by_document, "doc_id long, ords binary, flags binary")


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of FOUND, sorted by bucket, one row for each document: its flagged entries in order."""

    def finish(parts: list) -> Iterator[pa.RecordBatch]:
        doc, ord_, flag = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((ord_, doc))
        doc, ord_, flag = doc[order], ord_[order], flag[order]
        new = runs_of(doc, ord_)
        flag = np.maximum.reduceat(flag, new)
        doc, ord_ = doc[new], ord_[new]
        starts = np.append(runs_of(doc), len(doc))
        for i in range(0, len(starts) - 1, 4096):
            cut = list(zip(starts[i : i + 4096].tolist(), starts[i + 1 : i + 4097].tolist(), strict=False))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[[a for a, _ in cut]]), pa.array([ord_[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([flag[a:b].tobytes() for a, b in cut], pa.binary())], names=["doc_id", "ords", "flags"]
            )

    now, parts = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != now:
                if parts:
                    yield from finish(parts)
                now, parts = r["bucket"], []
            parts.append((unpack(r["doc"], np.int64), unpack(r["ord"], np.uint32), np.frombuffer(r["flag"], dtype=np.uint8)))
    if parts:
        yield from finish(parts)


def flagged(docs: DataFrame, emit: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], wanted: int = LATER, within: bool = False) -> DataFrame:
    """doc_id, ords (uint32) and flags (uint8) of the documents with entries of which a smaller document (LATER) or any other (SHARED) has the key.

    emit: from a batch of `docs`, keys (uint64), checks (uint32), doc_ids (int64) and ordinals; a doc_id must be in one row of `docs` only.
    """
    n = width(docs.sparkSession)
    n_ranges, n_buckets = 4 * n, n

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = emit(batch)
            if len(got[0]):
                yield from entries(*got, n_ranges, n_buckets, within)

    rows = by_ranges(docs.transform(in_python, send, ENTRIES), "kind", "range")
    return by_document(rows.transform(in_python, _ranges(n_buckets, wanted), FOUND))
