"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows against every window of the corpus.

A window is 13 consecutive item words; an item of fewer words, but not none, is one window of its
own length. Each text is scanned once: window hashes come from prefix sums, a bitmap drops nearly
all of them, a search in the sorted hash set the rest, and what is found there is compared word by
word, so no hash collision ever counts as a hit.

The set is a few NumPy arrays: sorted hashes, where each one's words are in the packed text of the
items, and the items that have it. It is broadcast, and it takes about ten times the text that it is
made of, so a benchmark of more than SLICE_BYTES of text is cut into slices by item. Then the texts
are numbered and written down once, and scanned for one slice after another; a slice's set is gone
before the next one is made, and the hits of all slices meet at the texts' numbers. So neither the
driver nor a worker ever holds more than one slice, however large the benchmark is.

Cases: a null or wordless text has no words and no hits; a null or wordless item has no windows;
items that repeat an item_id count as one item, a null item_id is named `null`; an empty benchmark
leaves every document clean; an overlap of windows counts each word once; rows that repeat, or that
have no doc_id, are judged one by one; `drop` keeps all columns of `documents` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import durable, fresh, in_python, table

WINDOW = 13
#: Bytes of benchmark text that become one set.
SLICE_BYTES = 8 << 20
#: The smallest share of a document's words that makes it contaminated: one in so many.
ONE_IN = 20


class Windows:
    """Windows of k words: their hashes, ascending, a bitmap of these, where their words are in `text`, and their items (`item` from `of` on)."""

    def __init__(self, k: int, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray, text: np.ndarray):
        order = np.lexsort((item, start, hashes))
        hashes, start, end, item = hashes[order], start[order], end[order], item[order]
        # Equal hashes with equal words are one window; the few equal hashes with other words stay windows of their own.
        lead, same = np.arange(len(hashes)), np.zeros(len(hashes), dtype=bool)
        for i in np.flatnonzero(hashes[1:] == hashes[:-1]).tolist():
            j = int(lead[i])
            if text[start[i + 1] : end[i + 1]].tobytes() == text[start[j] : end[j]].tobytes():
                lead[i + 1], same[i + 1] = j, True
        if not same.all() and (hashes[1:][~same[1:]] == hashes[:-1][~same[1:]]).any():
            # Windows that share a hash but not their words may have come in turns: bring equal ones together.
            words = [text[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            order = np.array(sorted(range(len(hashes)), key=lambda i: (int(hashes[i]), words[i], int(item[i]))))
            hashes, start, end, item = hashes[order], start[order], end[order], item[order]
            same = np.array([i > 0 and hashes[i] == hashes[i - 1] and words[order[i]] == words[order[i - 1]] for i in range(len(order))])
        first = np.flatnonzero(~same)
        window = np.cumsum(~same) - 1
        fresh_item = np.ones(len(item), dtype=bool)
        fresh_item[1:] = (item[1:] != item[:-1]) | (window[1:] != window[:-1])
        self.k, self.hashes, self.start, self.end = k, hashes[first], start[first], end[first]
        self.item = item[fresh_item].astype(np.int32)
        self.of = np.searchsorted(window[fresh_item], np.arange(len(first) + 1))
        bits = max(16, int(len(first) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        at = (self.hashes >> self.shift).astype(np.int64)
        self.bitmap = np.zeros(1 << bits - 3, dtype=np.uint8)
        np.bitwise_or.at(self.bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def likely(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes that may be known."""
        at = (h >> self.shift).astype(np.int64)
        return np.flatnonzero(self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)


class WindowSet:
    """The windows of some benchmark items, by length. names: item_ids, sorted; text: all items' words, each with a blank behind it."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        owner_of = np.array([number[i] for i, _ in items], dtype=np.int64)
        found: dict[int, list] = {}
        texts, size = [], 0
        for piece in bs.pieces(pa.array([text for _, text in items], pa.string())):
            w = bs.words(piece, bs.ALNUM)
            # The words of a window lie one after another in the packed text, so a window is one stretch of it.
            length = w.end - w.start
            place = np.concatenate(([0], np.cumsum(length + 1)))
            packed = np.full(place[-1], 32, dtype=np.uint8)
            take = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            packed[take + np.repeat(place[:-1], length)] = bs.LOWER[piece.data[take + np.repeat(w.start, length)]]
            counts = np.minimum(w.counts, window)
            for k in np.unique(counts[counts > 0]).tolist():
                at, hashes = bs.windows(w, k)
                owner = np.searchsorted(w.of, at, side="right") - 1
                mine = counts[owner] == k
                at, hashes, owner = at[mine], hashes[mine], owner[mine]
                found.setdefault(k, []).append((hashes, size + place[at], size + place[at + k] - 1, owner_of[piece.first + owner]))
            texts.append(packed)
            size += len(packed)
        self.text = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint8)
        self.by_length = [Windows(k, *(np.concatenate(x) for x in zip(*parts, strict=True)), self.text) for k, parts in sorted(found.items())]

    def hits(self, piece: bs.Piece) -> tuple[bs.Words, np.ndarray, np.ndarray, np.ndarray]:
        """The words; which of them are hit; texts and items (as numbers of names), each pair once, in order."""
        w = bs.words(piece, bs.ALNUM)
        start, end, texts, items = [], [], [], []
        sums, low = bs.WORDS.sums(w.hash), None
        for known in self.by_length:
            k = known.k
            at, h = bs.windows(w, k, sums)
            likely = known.likely(h)
            at, h = at[likely], h[likely]
            place, stop = np.searchsorted(known.hashes, h), np.searchsorted(known.hashes, h, side="right")
            for i, p, q in zip(at[place < stop].tolist(), place[place < stop].tolist(), stop[place < stop].tolist(), strict=True):
                low = bs.LOWER[piece.data].tobytes() if low is None else low
                phrase = b" ".join(low[a:b] for a, b in zip(w.start[i : i + k].tolist(), w.end[i : i + k].tolist(), strict=True))
                for p in range(p, q):  # nearly always one: hashes of 64 bits
                    if self.text[known.start[p] : known.end[p]].tobytes() == phrase:
                        start.append(i)
                        end.append(i + k)
                        mine = known.item[known.of[p] : known.of[p + 1]]
                        items.append(mine)
                        texts.append(len(mine))
        covered = bs.spread(len(w.start), np.array(start, dtype=np.int64), np.array(end, dtype=np.int64))
        if not items:
            return w, covered, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.searchsorted(w.of, np.array(start), side="right") - 1, texts)
        pairs = np.unique(owner * len(self.names) + np.concatenate(items))
        return w, covered, pairs // len(self.names), pairs % len(self.names)


def window_sets(benchmark: DataFrame, window: int, slice_bytes: int) -> tuple[int, Iterator[WindowSet]]:
    """The number of slices, and one set after another; a slice holds about slice_bytes of text, and at least one item."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // slice_bytes

    def sets():
        for i in range(n):
            part = b if n == 1 else b.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)
            yield WindowSet([(r.id, r.text) for r in part.collect()], window)

    return n, sets()


SCANNED = "array<struct<start:int,end:int>>"
FOUND = f"n_words long, hit {SCANNED}, items array<string>, spans {SCANNED}"
_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _ranges(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], _RANGES)


def _scan(shared, keep: tuple[str, ...], all_rows: bool = True):
    """The columns of `keep`, and of FOUND; of all rows, or of those only that a window of this set occurs in."""

    def run(batches):
        known = shared.value
        names = pa.array(known.names, pa.string())
        for batch in batches:
            n_words, hit, spans, items, rows = [], [], [], [], []
            for piece in bs.pieces(batch.column("text")):
                w, covered, texts, found = known.hits(piece)
                of = np.searchsorted(texts, np.arange(len(piece) + 1))
                n_words.append(w.counts)
                for d in range(len(piece)):
                    mine = found[of[d] : of[d + 1]]
                    if not len(mine):
                        if all_rows:
                            hit.append([])
                            spans.append([])
                            items.append([])
                        continue
                    rows.append(piece.first + d)
                    x, y = bs.spans(covered[w.of[d] : w.of[d + 1]])
                    at, base = piece.offsets[d], w.of[d]
                    hit.append(list(zip(x.tolist(), y.tolist(), strict=True)))
                    spans.append(list(zip((w.start[base + x] - at).tolist(), (w.end[base + y - 1] - at).tolist(), strict=True)))
                    items.append(names.take(pa.array(mine)).to_pylist())
            words = np.concatenate(n_words) if n_words else np.zeros(0, dtype=np.int64)
            columns = [batch.column(c) for c in keep]
            if not all_rows:
                words, columns = words[rows], [c.take(pa.array(rows, pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), _ranges(hit), pa.array(items, pa.list_(pa.string())), _ranges(spans)], names=[*keep, "n_words", "hit", "items", "spans"])

    return run


def _joined(batches):
    """Of each numbered text, what all slices found: hit runs of words as one set of runs, with their bytes; items as one list."""
    for batch in batches:
        n_words, n_hit, items, spans = [], [], [], []
        texts = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
        found = batch.column("found").to_pylist()
        for piece in bs.pieces(texts):
            w = bs.words(piece, bs.ALNUM)
            for d in range(len(piece)):
                mine = found[piece.first + d] or []
                base, at, size = int(w.of[d]), int(piece.offsets[d]), int(w.of[d + 1] - w.of[d])
                runs = [(r["start"], r["end"]) for f in mine for r in f["hit"]]
                x, y = bs.spans(bs.spread(size, np.array([r[0] for r in runs], dtype=np.int64), np.array([r[1] for r in runs], dtype=np.int64)))
                n_words.append(size)
                n_hit.append(int((y - x).sum()))
                spans.append(list(zip((w.start[base + x] - at).tolist(), (w.end[base + y - 1] - at).tolist(), strict=True)))
                items.append(sorted({i for f in mine for i in f["items"]}))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), _ranges(spans)], names=["doc_id", "text", "n_words", "n_hit", "items", "spans"]
        )


def _by_slices(numbered: DataFrame, sets: Iterator[WindowSet], number: str) -> DataFrame:
    """number and found, a list of (hit, items): one entry for each slice of which something occurs. One set is alive at a time."""
    parts = None
    for known in sets:
        shared = numbered.sparkSession.sparkContext.broadcast(known)
        del known
        part = durable(numbered.select(number, "text").transform(in_python, _scan(shared, (number,), all_rows=False), f"{number} long, {FOUND}"))
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(number).agg(F.collect_list(F.struct("hit", "items")).alias("found"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, keep_text: bool = False) -> DataFrame:
    """The rows of `docs`: doc_id, text if keep_text, n_words, n_hit, items (sorted) and spans, the byte ranges of hit runs of words.

    spans is a list of (start, end) into the text's UTF-8 bytes.
    """
    docs = docs.select("doc_id", "text")
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    kept = ("doc_id", "text") if keep_text else ("doc_id",)
    n, sets = window_sets(benchmark, window, slice_bytes)
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(sets))
        found = docs.transform(in_python, _scan(shared, kept), f"doc_id {doc_id}, {'text string, ' * keep_text}{FOUND}")
        n_hit = F.coalesce(F.expr("aggregate(hit, 0L, (n, x) -> n + x.end - x.start)"), F.lit(0))
        return found.select(*kept, "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), "spans")
    numbered = durable(docs.withColumn("number", F.monotonically_increasing_id()))
    found = numbered.join(_by_slices(numbered, sets, "number"), "number", "left").select("doc_id", "text", "found")
    joined = found.transform(in_python, _joined, f"doc_id {doc_id}, text string, n_words long, n_hit long, items array<string>, spans {SCANNED}")
    return joined if keep_text else joined.drop("text")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns."""
    n, sets = window_sets(benchmark, window, slice_bytes)
    if n > 1:
        (number,) = fresh(docs, "number")
        numbered = durable(docs.withColumn(number, F.monotonically_increasing_id()))
        found = numbered.select(number, "text").join(_by_slices(numbered, sets, number), number).select(F.col(number).alias("doc_id"), "text", "found")
        judged = found.transform(in_python, _joined, f"doc_id long, text string, n_words long, n_hit long, items array<string>, spans {SCANNED}")
        dirty = judged.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(number))
        return numbered.join(dirty, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(next(sets))

    def run(batches):
        known = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = np.ones(len(texts), dtype=bool)
            for piece in bs.pieces(texts):
                w, covered, _, _ = known.hits(piece)
                counts = np.concatenate(([0], np.cumsum(covered)))
                hit = counts[w.of[1:]] - counts[w.of[:-1]]
                keep[piece.first : piece.first + len(piece)] = ~((hit > 0) & (ONE_IN * hit >= w.counts))
            yield batch.filter(pa.array(keep))

    return docs.transform(in_python, run, docs.schema)


def strip_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id and text of all documents, the hit runs of words cut out of the text."""
    return contamination(docs, benchmark, window, slice_bytes, keep_text=True).transform(in_python, _strip, "doc_id long, text string")


def _strip(batches):
    for batch in batches:
        texts = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if cuts:
                raw, at, kept = text.encode(), 0, []
                for s in cuts:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                text = (b"".join(kept) + raw[at:]).decode()
            texts.append(text)
        yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
found AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT f.doc_id, f.k, f.i, windows.item FROM found f JOIN windows ON f.phrase = windows.phrase AND f.k = windows.k),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
