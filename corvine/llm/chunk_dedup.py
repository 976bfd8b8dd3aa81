"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where the hash's high bits are zero, LEAST bytes at
the earliest and MOST at the latest, so boundaries follow the content and find step again after an
insertion. What is left at a text's end belongs to its last chunk where it has fewer than LEAST
bytes, so chunks have LEAST bytes at least, more than what recurs by chance, and only a text of
fewer is one shorter chunk, which is compared with such texts only. A chunk is a duplicate if its
digest (96 bits) occurred before, in a document with a smaller doc_id or earlier in its own; all
duplicates are cut out, the first occurrence stays. So exact copies go completely, whatever their
length, and of a longer passage all chunks but those that its ends cut through.

Digests meet in the packed exchange of `exchange`: one entry for each batch and digest, whatever the
size of a group of copies, and no pairs. The gear hash is exact but vectorised: five shift-and-add
steps give the sum over the last 32 bytes.

Cases: a null text counts as empty, with no chunks; of rows that share a doc_id the largest text
stands for them; a null doc_id is smaller than all others; texts of any length are chunked whole; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import NO_ID, in_python, one_per_id, table, with_flags
from .exchange import LATER, flagged

LEAST, MOST, BITS = 64, 512, 4
#: Tells the digests of whole short texts from those of chunks.
WHOLE = np.uint64(0x73686F7274)
GEAR = (bs.alphabet(0x67656172) >> np.uint64(32)).astype(np.uint32)
CHECK = bs.Hasher(bs.BASE, 99)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + GEAR[data[i]] modulo 2**32, for all i."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        before = np.zeros_like(h)
        before[step:] = h[:-step]
        h = h + (before << np.uint32(step))
    return h


def chunk_ends(piece: bs.Piece, least: int = LEAST, most: int = MOST, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and the number of chunks of each text.

    The first `least` bytes of a chunk never end it, and a text's first chunk has the hash's 32 bytes at least, so no hash that reaches into the text before is used.
    """
    marks = np.flatnonzero(gear(piece.data) >> np.uint32(32 - bits) == 0) + 1
    bounds = np.searchsorted(marks, piece.offsets)
    ends: list[int] = []
    counts = np.zeros(len(piece), dtype=np.int64)
    for d, (a, b) in enumerate(zip(piece.offsets[:-1].tolist(), piece.offsets[1:].tolist(), strict=True)):
        had = len(ends)
        at, floor, stop = a, max(least, 32), b - least
        for m in marks[bounds[d] : bounds[d + 1]].tolist():
            if m > stop:
                break
            while m - at > most:
                at += most
                ends.append(at)
                floor = least
            if m - at >= floor:
                ends.append(m)
                at, floor = m, least
        while b - at > most and at + most <= stop:
            at += most
            ends.append(at)
        if b > at:
            ends.append(b)
        counts[d] = len(ends) - had
    return np.array(ends, dtype=np.int64), counts


def _emit(batch: pa.RecordBatch):
    ids, out = batch.column("doc_id").to_numpy(), []
    for piece in bs.pieces(batch.column("text")):
        ends, counts = chunk_ends(piece)
        if not len(ends):
            continue
        owner = np.repeat(np.arange(len(piece)), counts)
        start = np.concatenate(([0], ends[:-1]))
        key = bs.BYTES.of(piece.data, start, ends)
        key = np.where(ends - start < LEAST, bs.mix(key ^ WHOLE), key)
        check = (CHECK.of(piece.data, start, ends) >> np.uint64(32)).astype(np.uint32)
        out.append((key, check, ids[piece.first + owner].astype(np.int64), np.arange(len(ends)) - (np.cumsum(counts) - counts)[owner]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 4


def _decide(batches):
    """doc_id, text and the flagged ordinals -> the kept text and counts."""
    for batch in batches:
        ids, ords = batch.column("doc_id"), batch.column("ords")
        for piece in bs.pieces(batch.column("text")):
            rows = []
            ends, counts = chunk_ends(piece)
            first = np.cumsum(counts) - counts
            for d in range(len(piece)):
                a, b = int(piece.offsets[d]), int(piece.offsets[d + 1])
                raw = ords[piece.first + d].as_py()
                mine = ends[first[d] : first[d] + counts[d]]
                spans, cut = [], 0
                if raw:
                    begins = np.concatenate(([a], mine[:-1]))
                    dup = np.zeros(len(mine), dtype=bool)
                    dup[np.frombuffer(raw, dtype=np.uint32)] = True
                    spans, cut = [(int(begins[x]), int(mine[y - 1])) for x, y in zip(*bs.spans(dup), strict=True)], int(dup.sum())
                kept, at = [], a
                for x, y in spans:
                    kept.append(piece.data[at:x].tobytes())
                    at = y
                kept.append(piece.data[at:b].tobytes())
                rows.append((len(mine), cut, b - a, sum(y - x for x, y in spans), len(spans), b"".join(kept)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([ids.slice(piece.first, len(piece)), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary())], names=["doc_id", "n_chunks", "n_duplicate", "n_bytes", "n_removed", "n_spans", "kept"])


KEPT = "doc_id long, n_chunks long, n_duplicate long, n_bytes long, n_removed long, n_spans long, kept binary"


def chunk_dedup(docs: DataFrame) -> DataFrame:
    """One row for each doc_id: n_chunks, n_duplicate (chunks cut out), n_bytes, n_removed, n_spans (runs cut out) and kept, the bytes left."""
    texts = one_per_id(docs)
    found = with_flags(texts, flagged(texts, _emit, LATER, within=True)).transform(in_python, _decide, KEPT)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op5_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
