"""Exact substring deduplication with a logarithmic family of suffix arrays.

Removed is each byte covered by a LENGTH-byte string that also starts in a document with a smaller
doc_id. Strings are judged on the input and never cross documents.

1. Of texts that are the same byte for byte, the one with the smallest doc_id stands for all; the
   others go as a whole if they have LENGTH bytes.
2. Every LENGTH-byte string holds a gram of GRAM bytes whose rolling hash is the smallest in it, so
   two equal strings hold equal ones. Grams that are smallest anywhere, about 1 of 18 positions, go
   through the packed exchange; those that only one document has end the matter for their strings.
3. For each other gram of a standing document, the stretch of strings that it is smallest in goes, a
   compressed batch at a time, to the task that holds the gram's range of hashes. A batch's strings,
   the suffixes at all places of its stretches up to LENGTH bytes, are sorted into a suffix array
   there, which is merge-scanned against the levels of a family of suffix arrays and then joins it;
   levels of about equal size merge geometrically. Strings are compared by their bytes.
   A gram that many strings choose (a rule of dashes, a line of blanks) would fill one range: strings
   of grams that take more than a fair share of a sample go by themselves, by their own hash.
4. What is covered goes to the documents, which are cut.

Of equal stretches in one batch the smallest document's goes to the range, and the others are
settled on the spot: a passage or a copy that a third of all documents share costs a stretch a batch.
Each step is a pure function of its rows, and ranges and document buckets grow with
spark.sql.shuffle.partitions, so a task's memory doesn't grow with the data.

Cases: a null text counts as empty; texts of fewer than LENGTH bytes lose nothing; strings that
repeat within one document only stay; of rows that share a doc_id the largest text stands for them; a
null doc_id is smaller than all others; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .chunk_dedup import GEAR
from .common import NO_ID, by_ranges, durable, in_python, one_per_id, table, width
from .exchange import FOUND, LATER, SHARED, Outbox, by_document, flagged, pack, runs_of, settled_rows, unpack

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
_TOP = np.uint32(0xFFFFFFFF)
#: Strings that are gathered before they become a suffix array.
BATCH = 1 << 18
#: Bytes of text whose stretches are compared before they are sent.
LOT = 32 << 20
#: Rows, at least, and for each range, in which frequent grams are looked for; the least share, in fair shares of a range, of one.
SAMPLE_ROWS, ROWS_PER_RANGE, FAIR = 2_000, 8, 0.25
STRETCHES = "range int, kind int, doc binary, start binary, many binary, bytes binary"


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes from each place on: four shift-and-add steps, then a multiplication."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        after = np.zeros_like(h)
        after[: max(len(h) - step, 0)] = h[step:]
        h = h + (after << np.uint32(step))
    return h * np.uint32(2654435761)


def sliding(x: np.ndarray, span: int, best) -> np.ndarray:
    """best of x[i : i + span], shorter at the end."""
    have = 1
    while have < span:
        step = min(have, span - have)
        y = x.copy()
        y[: max(len(x) - step, 0)] = best(x[: max(len(x) - step, 0)], x[step:])
        x, have = y, have + step
    return x


class Grams:
    """Of a piece: hashes of grams, the smallest of each string by where it starts, room to the text's end, and the chosen grams."""

    def __init__(self, piece: bs.Piece):
        n = len(piece.data)
        self.room = np.repeat(piece.offsets[1:], np.diff(piece.offsets)) - np.arange(n)
        self.hash = gram_hashes(piece.data)
        self.hash[self.room < GRAM] = _TOP
        self.least = sliding(self.hash, SPAN, np.minimum)
        highest = sliding(self.least[::-1], SPAN, np.maximum)[::-1]
        # Strings that would cross into the next text choose a few grams too many, never too few; so grams are named by their places.
        self.at = np.flatnonzero((highest == self.hash) & (self.room >= GRAM))
        self.doc = np.searchsorted(piece.offsets, self.at, side="right") - 1


def _emit_grams(batch: pa.RecordBatch):
    ids, out = batch.column("doc_id").to_numpy(), []
    for piece in bs.pieces(batch.column("text")):
        g = Grams(piece)
        key = bs.BYTES.of(piece.data, g.at, g.at + GRAM)
        # A filter only, so 48 bits do.
        out.append((key & np.uint64(0xFFFFFFFFFFFF0000), np.zeros(len(key), dtype=np.uint32), ids[piece.first + g.doc].astype(np.int64), g.at - piece.offsets[g.doc]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 4


def _stretches(piece: bs.Piece, shared: list) -> tuple[np.ndarray, ...]:
    """Of shared grams the key, the text, and the first and last string that each is smallest in."""
    g = Grams(piece)
    places = [np.frombuffer(raw, dtype=np.uint32).astype(np.int64) for raw in shared]
    doc = np.repeat(np.arange(len(places)), [len(x) for x in places])
    at = np.concatenate(places or [np.zeros(0, np.int64)]) + piece.offsets[doc]
    first, last = np.full(len(at), -1), np.full(len(at), -1)
    for back in range(SPAN - 1, -1, -1):
        p = at - back
        ok = p >= piece.offsets[doc]
        ok[ok] = (g.least[p[ok]] == g.hash[at[ok]]) & (g.room[p[ok]] >= LENGTH)
        last[ok] = p[ok]
        first[ok & (first < 0)] = p[ok & (first < 0)]
    full = first >= 0
    at, doc, first, last = at[full], doc[full], first[full], last[full]
    return bs.BYTES.of(piece.data, at, at + GRAM), doc, first, last


def frequent_grams(texts: DataFrame, n_ranges: int) -> np.ndarray:
    """Grams that are smallest for more than FAIR / n_ranges of a sample's strings: at most n_ranges / FAIR of them. They only decide where strings meet."""

    def run(batches):
        for batch in batches:
            for piece in bs.pieces(batch.column("text")):
                g = Grams(piece)
                key, many = np.unique(bs.BYTES.of(piece.data, g.at, g.at + GRAM), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(many.astype(np.int64))], names=["gram", "n"])

    rows = texts.count()
    share = min(1.0, max(SAMPLE_ROWS, ROWS_PER_RANGE * n_ranges) / max(rows, 1))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counted = durable(sample.transform(in_python, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("n") > FAIR * total / n_ranges).where("n > 1").select("gram").collect()
    return np.sort(np.array([r.gram for r in found], dtype=np.int64).view(np.uint64))


def _singly(hot: np.ndarray, key, doc, start, many, at, data):
    """Stretches of frequent grams taken apart: each different string of a document is a stretch of one, keyed by its own hash."""
    split = np.isin(key, hot)
    if not split.any():
        return key, doc, start, many, at
    size = many[split]
    own = np.repeat(np.flatnonzero(split), size)
    step = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    where = at[own] + step
    by_place = np.argsort(where, kind="stable")
    string = np.empty(len(where), dtype=np.uint64)
    string[by_place] = bs.BYTES.of(data, where[by_place], where[by_place] + LENGTH)
    parts = (string, doc[own], start[own] + step, np.ones(len(own), dtype=many.dtype), where)
    key, doc, start, many, at = (np.concatenate((x[~split], p)) for x, p in zip((key, doc, start, many, at), parts, strict=True))
    order = np.argsort(key, kind="stable")
    return key[order], doc[order], start[order], many[order], at[order]


def _send_stretches(n_ranges: int, n_buckets: int, hot: np.ndarray):
    def send(parts: list, raw: list):
        key, whole, doc, start, many, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        data = np.concatenate(raw)
        order = bs.order_by(key, whole, doc)
        key, whole, doc, start, many, at = (x[order] for x in (key, whole, doc, start, many, at))
        # Equal hashes of stretches are believed only if the bytes are equal, too.
        groups = runs_of(key, whole)
        lead = np.repeat(groups, np.diff(np.append(groups, len(key))))
        later = np.flatnonzero((doc > doc[lead]) & (many == many[lead]))
        same = [data[at[i] : at[i] + many[i] + LENGTH - 1].tobytes() == data[at[j] : at[j] + many[i] + LENGTH - 1].tobytes() for i, j in zip(later.tolist(), lead[later].tolist(), strict=True)]
        later = later[np.array(same, dtype=bool)]
        if len(later):
            for rows in settled_rows(doc[later], start[later], (many[later] + LENGTH - 1).astype(np.uint8), n_buckets):
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(4), rows.column(5), rows.column(3), pa.nulls(len(rows), pa.binary())], names=["range", "kind", "doc", "start", "many", "bytes"])
        sent = np.ones(len(key), dtype=bool)
        sent[later] = False
        key, doc, start, many, at = _singly(hot, *(x[sent] for x in (key, doc, start, many, at)), data)
        place = (key >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)
        cuts = np.append(runs_of(place), len(place))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            size = many[a:b] + LENGTH - 1
            take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[a:b], size)
            rows.append((int(place[a]), 0, pack(doc[a:b]), pack(start[a:b].astype(np.uint32)), many[a:b].astype(np.uint8).tobytes(), _zstd()[0].compress(data[take].tobytes())))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["range", "kind", "doc", "start", "many", "bytes"])

    def run(batches):
        parts, raw, base = [], [], 0
        for batch in batches:
            ids, shared = batch.column("doc_id").to_numpy(), batch.column("ords").to_pylist()
            for piece in bs.unpacked(batch.column("packed"), _zstd()[1].decompress):
                key, doc, first, last = _stretches(piece, shared[piece.first : piece.first + len(piece)])
                by_start = np.argsort(first, kind="stable")
                whole = np.empty(len(first), dtype=np.uint64)
                whole[by_start] = bs.BYTES.of(piece.data, first[by_start], last[by_start] + LENGTH)
                parts.append((key, whole, ids[piece.first + doc].astype(np.int64), first - piece.offsets[doc], last - first + 1, first + base))
                raw.append(piece.data)
                base += len(piece.data)
                if base >= LOT:
                    yield from send(parts, raw)
                    parts, raw, base = [], [], 0
        if parts:
            yield from send(parts, raw)

    return run


class SuffixFamily:
    """Levels of suffix arrays: strings in byte order, each with the smallest document that has it and that one's slot.

    `later[slot]` says whether a smaller document has the string that was added there.
    """

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.later = np.zeros(1024, dtype=bool)
        self.slots = 0
        self.mates: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, strings: np.ndarray, doc: np.ndarray) -> None:
        n, base = len(strings), self.slots
        self.slots += n
        if self.slots > len(self.later):
            self.later = np.concatenate((self.later, np.zeros(max(len(self.later), n), dtype=bool)))
        by_doc = np.argsort(doc, kind="stable")
        order = by_doc[np.argsort(strings[by_doc], kind="stable")]
        text, owner = strings[order], doc[order]
        first = runs_of(text)
        lead = np.repeat(first, np.diff(np.append(first, n)))
        self.later[base + order[owner > owner[lead]]] = True
        # Equal strings of the leading document share its fate; the first of them stands for all.
        mates = np.flatnonzero((owner == owner[lead]) & (lead != np.arange(n)))
        if len(mates):
            self.mates.append((base + order[lead[mates]], base + order[mates]))
        new, who, slot = text[first], owner[first], base + order[first]
        free = np.ones(len(new), dtype=bool)
        for keys, docs, slots in self.levels:
            at = np.searchsorted(keys, new)
            at[at == len(keys)] = 0
            same = np.flatnonzero((keys[at] == new) & free)
            there = at[same]
            older = docs[there] <= who[same]
            self.later[slot[same[older]]] |= docs[there[older]] < who[same[older]]
            won, lost = same[~older], there[~older]
            self.later[slots[lost]] = True
            docs[lost], slots[lost] = who[won], slot[won]
            free[same] = False
        if free.any():
            self.levels.append([new[free], who[free].copy(), slot[free]])
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            both = [np.concatenate((x, y)) for x, y in zip(b, a, strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.levels.append([x[order] for x in both])

    def verdict(self) -> np.ndarray:
        later = self.later[: self.slots].copy()
        for lead, mate in self.mates:
            later[mate] |= later[lead]
        return later


def strings_of(data: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The LENGTH-byte strings of stretches that lie one after another in data."""
    size = many + LENGTH - 1
    begin = np.cumsum(size) - size
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    return np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at].view(f"S{LENGTH}").reshape(-1)


def _ranges(n_buckets: int):
    """Rows of FOUND from rows of STRETCHES that are sorted by kind and range."""

    def covered(family: SuffixFamily, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        later = family.verdict()
        doc, start, many = (np.concatenate([k[i] for k in kept]) for i in range(3))
        of = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(later)) - np.repeat(np.cumsum(many) - many, many)
        on = np.flatnonzero(later)
        # Runs of covered strings of one stretch: one range of bytes each.
        head = np.ones(len(on), dtype=bool)
        head[1:] = (np.diff(on) > 1) | (of[on[1:]] != of[on[:-1]])
        first = np.flatnonzero(head)
        a, b = on[first], on[np.append(first[1:], len(on)) - 1] if len(on) else on
        return doc[of[a]], start[of[a]] + place[a], (place[b] - place[a] + LENGTH).astype(np.uint8)

    def run(batches):
        out = Outbox(n_buckets)
        now, family, kept, waiting = None, SuffixFamily(), [], []

        def index():
            if waiting:
                family.add(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
                waiting.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"]:
                    yield from out.put(unpack(r["doc"], np.int64), unpack(r["start"], np.uint32).astype(np.int64), np.frombuffer(r["many"], dtype=np.uint8))
                    continue
                if r["range"] != now:
                    index()
                    if kept:
                        yield from out.put(*covered(family, kept))
                    now, family, kept = r["range"], SuffixFamily(), []
                doc, start, many = unpack(r["doc"], np.int64), unpack(r["start"], np.uint32).astype(np.int64), np.frombuffer(r["many"], dtype=np.uint8).astype(np.int64)
                waiting.append((strings_of(np.frombuffer(_zstd()[1].decompress(r["bytes"]), dtype=np.uint8), many), np.repeat(doc, many)))
                kept.append((doc, start, many))
                if sum(len(w[0]) for w in waiting) >= BATCH:
                    index()
        index()
        if kept:
            yield from out.put(*covered(family, kept))
        yield from out.flush()

    return run


def _pack_texts(batches):
    for batch in batches:
        packed = [_zstd()[0].compress(x.as_buffer()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _cut(batches):
    for batch in batches:
        rows, size, at_row = [], 0, 0
        for packed, is_copy, ords, sizes in zip(*[batch.column(c).to_pylist() for c in ("packed", "is_copy", "ords", "flags")], strict=True):
            text = _zstd()[1].decompress(packed)
            n = len(text)
            if is_copy:
                spans = [(0, n)] if n >= LENGTH else []
            elif ords:
                start = np.frombuffer(ords, dtype=np.uint32).astype(np.int64)
                a, b = bs.spans(bs.spread(n, start, start + np.frombuffer(sizes, dtype=np.uint8)))
                spans = list(zip(a.tolist(), b.tolist(), strict=True))
            else:
                spans = []
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((n, sum(b - a for a, b in spans), len(spans), b"".join(kept)))
            size += n
            if size >= 8 * bs.PIECE or at_row + len(rows) == len(batch):
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at_row, len(rows)), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                rows, size, at_row = [], 0, at_row + len(rows)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each doc_id: n_bytes, n_removed, n_spans and kept, the bytes left."""
    n = width(docs.sparkSession)
    n_ranges, n_buckets = 4 * n, n
    texts = one_per_id(docs)
    same = texts.select("doc_id", F.octet_length("text").alias("size"), F.unhex(F.md5("text")).alias("digest"), F.xxhash64("text").alias("digest2"))
    keys = ["size", "digest", "digest2"]
    standing = same.groupBy(keys).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = durable(same.join(standing, keys).where("doc_id <> keeper").select("doc_id", F.lit(True).alias("is_copy")))
    shared = flagged(texts, _emit_grams, LATER | SHARED)
    wanted = shared.select("doc_id", "ords").join(copies, "doc_id", "left_anti")
    packed = texts.transform(in_python, _pack_texts, "doc_id long, packed binary")
    hot = frequent_grams(texts, n_ranges)
    stretches = packed.join(wanted, "doc_id").transform(in_python, _send_stretches(n_ranges, n_buckets, hot), STRETCHES)
    covered = by_document(by_ranges(stretches, "kind", "range").transform(in_python, _ranges(n_buckets), FOUND))
    known = covered.join(copies, "doc_id", "full")
    cut = packed.join(known, "doc_id", "left").select("doc_id", "packed", "is_copy", "ords", "flags").transform(in_python, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
