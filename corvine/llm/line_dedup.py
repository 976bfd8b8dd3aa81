"""Line deduplication: winnowing over line hashes.

A document is the sequence of its non-blank lines, trimmed and lower-cased (A-Z). Grams of GRAM
consecutive lines are hashed, and of every WINDOW consecutive grams the smallest hash (the last of
equals) is a fingerprint: any repeated run of RUN = GRAM + WINDOW - 1 lines holds one in both its
places. Fingerprints that occur in several places are joined by the packed exchange; around them
matches are extended both ways, as every run of RUN lines that contains one is looked up in a second
exchange, with the line hashes' 96 bits. A run is repeated if it started before, in a document with
a smaller doc_id or earlier in its own, and the lines of all repeated runs are deleted, so that a
longer passage goes as a whole and its first occurrence stays.

Lines can be long, so three lines are not the least passage that matters. With `least_words`, a
run of one or two lines with so many words is a unit of its own, compared in an exchange of its own,
and so is the whole of a document of one or two lines, whatever its length, with other such wholes.
Then every repeated passage of whole lines with `least_words` words goes, however its lines are
broken, and copies of short documents are emptied.

Only hashes travel: texts are read once to hash their lines and once to cut them.

Cases: a null text counts as empty; without `least_words` documents of fewer than RUN lines lose nothing; blank lines
count as no lines and go if they lie between deleted ones; runs that overlap themselves keep their
first RUN lines; of rows that share a doc_id the one with the largest text stands for them; a null
doc_id is smaller than all others; an empty table gives an empty result; `deduplicated` keeps all
columns whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import NO_ID, durable, fresh, in_python, one_per_id, one_row_per_id, table
from .exchange import LATER, SHARED, flagged

GRAM, WINDOW = 2, 2
RUN = GRAM + WINDOW - 1
CHECK = bs.Hasher(bs.BASE, 5)
LINES = bs.Hasher(bs.BASE, 6)
#: Words from which one or two lines are a passage, 255 at most; tells apart the keys of whole documents.
LEAST_WORDS = 50
WHOLE = np.uint64(0x57484F4C45)


def text_lines(piece: bs.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of non-blank lines; the same of what is left of them when trimmed; and the first line of each text."""
    data, offsets = piece.data, piece.offsets
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    solid = np.flatnonzero(bs.NOT_BLANK[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = a < b
    start, end, a, b = start[full], end[full], a[full], b[full]
    return start, end, solid[a] if len(a) else a, (solid[b - 1] + 1 if len(b) else b), np.searchsorted(start, offsets)


def line_words(piece: bs.Piece, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of words of trimmed lines."""
    solid = bs.NOT_BLANK[piece.data]
    begins = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    return np.searchsorted(begins, b) - np.searchsorted(begins, a, side="right") + 1


HASHED = "doc_id long, lines binary, checks binary, words binary"


def _hash_lines(least: int):
    """Of documents of `least` or more lines, the lines' hashes, checks and numbers of words."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id").to_numpy(), []
            for piece in bs.pieces(batch.column("text")):
                _, _, a, b, of = text_lines(piece)
                low = bs.LOWER[piece.data]
                key = LINES.of(low, a, b)
                check = (CHECK.of(low, a, b) >> np.uint64(32)).astype(np.uint32)
                words = np.minimum(line_words(piece, a, b), 255).astype(np.uint8) if least < RUN else np.zeros(len(a), dtype=np.uint8)
                for d in np.flatnonzero(np.diff(of) >= least).tolist():
                    x, y = of[d], of[d + 1]
                    rows.append((int(ids[piece.first + d]), key[x:y].tobytes(), check[x:y].tobytes(), words[x:y].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 3))], names=["doc_id", "lines", "checks", "words"])

    return run


def _sequences(batch: pa.RecordBatch):
    """Of a batch of hashed documents: their ids, all line hashes and checks, and the first line of each."""
    lines = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("lines").to_pylist()]
    checks = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("checks").to_pylist()]
    of = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int64)
    return batch.column("doc_id").to_numpy(), np.concatenate(lines or [np.zeros(0, np.uint64)]), np.concatenate(checks or [np.zeros(0, np.uint32)]), of


def _runs(hashes: np.ndarray, of: np.ndarray, k: int, hasher: bs.Hasher = bs.WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of k lines within documents: their first lines, documents and hashes."""
    counts = np.diff(of)
    room = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), room)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + of[:-1][doc]
    return at, doc, hasher.slices(hasher.sums(hashes), at, at + k)


def winnow(hashes: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Places of fingerprints: of each `window` neighbours of one document, the last of the smallest."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(n)
    for i in range(1, window):
        nxt = np.arange(n) + i
        best = np.where(hashes[nxt] <= hashes[best], nxt, best)
    return np.unique(best[doc[:n] == doc[window - 1 :]])


def _fingerprints(batch: pa.RecordBatch):
    ids, lines, _, of = _sequences(batch)
    at, doc, h = _runs(lines, of, GRAM)
    chosen = winnow(h, doc, WINDOW)
    return h[chosen], np.zeros(len(chosen), dtype=np.uint32), ids[doc[chosen]], at[chosen] - of[doc[chosen]]


def _around(batch: pa.RecordBatch):
    """Runs that contain a fingerprint found in several places."""
    ids, lines, checks, of = _sequences(batch)
    near = np.zeros(len(lines) + 1, dtype=np.int64)
    for d, raw in enumerate(batch.column("ords").to_pylist()):
        near[of[d] + np.frombuffer(raw, dtype=np.uint32).astype(np.int64)] = 1
    near = np.concatenate(([0], np.cumsum(near)))
    at, doc, h = _runs(lines, of, RUN)
    chosen = np.flatnonzero(near[at + WINDOW] > near[at])
    check = (CHECK.slices(CHECK.sums(checks.astype(np.uint64)), at[chosen], at[chosen] + RUN) >> np.uint64(32)).astype(np.uint32)
    return h[chosen], check, ids[doc[chosen]], at[chosen] - of[doc[chosen]]


def _passages(least_words: int):
    """Runs of one and of two lines with `least_words` words, and whole documents of one or two lines; ords are 4 x first line + lines."""

    def emit(batch: pa.RecordBatch):
        ids, lines, checks, of = _sequences(batch)
        words = np.concatenate([np.zeros(1, np.uint8), *(np.frombuffer(x, dtype=np.uint8) for x in batch.column("words").to_pylist())]).cumsum(dtype=np.int64)
        sums, out = CHECK.sums(checks.astype(np.uint64)), []
        for k in range(1, RUN):
            at, doc, h = _runs(lines, of, k)
            long = words[at + k] - words[at] >= least_words
            chosen = np.flatnonzero(long | (np.diff(of)[doc] == k))
            at, doc, long = at[chosen], doc[chosen], long[chosen]
            key = np.where(long, h[chosen], bs.mix(h[chosen] ^ WHOLE))
            out.append((key, (CHECK.slices(sums, at, at + k) >> np.uint64(32)).astype(np.uint32), ids[doc], 4 * (at - of[doc]) + k))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return emit


def later_runs(texts: DataFrame, least_words: int | None = None) -> DataFrame:
    """doc_id and ords, the first lines (uint32) of runs of RUN lines that started before; passages, those of `_passages`. texts: doc_id, unique, and text."""
    hashed = durable(texts.select("doc_id", "text").transform(in_python, _hash_lines(1 if least_words else RUN), HASHED))
    shared = flagged(hashed, _fingerprints, LATER | SHARED, within=True)
    near = hashed.join(shared.select("doc_id", "ords"), "doc_id")
    found = flagged(near, _around, LATER, within=True).select("doc_id", "ords")
    if not least_words:
        return found.withColumn("passages", F.lit(None).cast("binary"))
    return found.join(flagged(hashed, _passages(least_words), LATER, within=True).select("doc_id", F.col("ords").alias("passages")), "doc_id", "full")


def _cut(piece: bs.Piece, later: list, passages: list) -> list[tuple[bytes, int, int]]:
    """Of each text: what is left, its number of lines and of deleted ones."""
    start, end, _, _, of = text_lines(piece)
    out = []
    for d in range(len(piece)):
        a, b, x, y = int(piece.offsets[d]), int(piece.offsets[d + 1]), int(of[d]), int(of[d + 1])
        raw, long = later[piece.first + d], passages[piece.first + d]
        if not raw and not long:
            out.append((piece.data[a:b].tobytes(), y - x, 0))
            continue
        runs, long = (np.frombuffer(r or b"", dtype=np.uint32).astype(np.int64) for r in (raw, long))
        gone = bs.spread(y - x, np.concatenate((runs, long // 4)), np.concatenate((runs + RUN, long // 4 + long % 4)))
        kept, at = [], a
        for i, j in zip(*bs.spans(gone), strict=True):
            kept.append(piece.data[at : start[x + i]].tobytes())
            at = int(end[x + j - 1])
        kept.append(piece.data[at:b].tobytes())
        out.append((b"".join(kept), y - x, int(gone.sum())))
    return out


def line_dedup(docs: DataFrame, least_words: int | None = None) -> DataFrame:
    """One row for each doc_id: n_lines, n_removed and kept, the text without the deleted lines."""
    texts = one_per_id(docs)

    def run(batches):
        for batch in batches:
            later, passages, rows = batch.column("ords").to_pylist(), batch.column("passages").to_pylist(), []
            for piece in bs.pieces(batch.column("text")):
                rows += _cut(piece, later, passages)
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[0], pa.binary())], names=["doc_id", "n_lines", "n_removed", "kept"])

    found = texts.join(later_runs(texts, least_words), "doc_id", "left").transform(in_python, run, "doc_id long, n_lines long, n_removed long, kept binary")
    return found.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_lines", "n_removed", F.col("kept").cast("string").alias("kept"))


def deduplicated(docs: DataFrame, least_words: int | None = None) -> DataFrame:
    """`docs`, one row for each doc_id, with all columns, repeated lines deleted from text."""
    rows = one_row_per_id(docs)
    at = rows.columns.index("text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    names = fresh(rows, "id_of_runs", "later_runs", "later_passages")
    later = later_runs(one_per_id(rows), least_words).select(*[F.col(c).alias(x) for c, x in zip(("doc_id", "ords", "passages"), names, strict=True)])

    def run(batches):
        for batch in batches:
            later, passages, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), []
            text = batch.column(at)
            for piece in bs.pieces(text):
                texts += [x[0].decode() for x in _cut(piece, later, passages)]
            texts = pa.array([None if v is None else x for x, v in zip(texts, text.to_pylist(), strict=True)], pa.string()) if text.null_count else pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns - 2)], names=batch.schema.names[:-2])

    joined = rows.join(later, key == later[names[0]], "left").drop(names[0])
    return joined.transform(in_python, run, docs.schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), LEAST_WORDS).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_SPLIT = "string_split(coalesce(text, ''), chr(10))"
_TRIMMED = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
_WORDS = r"len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))"
ORACLE = f"""
WITH lines AS (SELECT doc_id, unnest({_SPLIT}) AS line, generate_subscripts({_SPLIT}, 1) AS place, len({_SPLIT}) AS n FROM documents),
solid AS (
  SELECT doc_id, place, translate({_TRIMMED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i
  FROM lines WHERE {_TRIMMED} <> ''),
runs AS (
  SELECT doc_id, i, l AS a, lead(l, 1) OVER w AS b, lead(l, 2) OVER w AS c, {_WORDS} AS words, lead({_WORDS}, 1) OVER w AS more, count(*) OVER (PARTITION BY doc_id) AS n
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
units AS (
  SELECT doc_id, i, 3 AS k, a, b, c, FALSE AS short FROM runs WHERE c IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, a, b, NULL, words + more < {LEAST_WORDS} FROM runs WHERE b IS NOT NULL AND (words + more >= {LEAST_WORDS} OR n = 2)
  UNION ALL SELECT doc_id, i, 1, a, NULL, NULL, words < {LEAST_WORDS} FROM runs WHERE words >= {LEAST_WORDS} OR n = 1),
later AS (SELECT doc_id, i, k FROM (SELECT *, row_number() OVER (PARTITION BY k, a, b, c, short ORDER BY doc_id, i) AS r FROM units) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + v.j AS i FROM later, (VALUES (0), (1), (2)) AS v(j) WHERE v.j < k),
marked AS (SELECT s.doc_id, s.place, g.i IS NOT NULL AS gone FROM solid s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i),
placed AS (
  SELECT l.doc_id, l.line || CASE WHEN l.place < l.n THEN chr(10) ELSE '' END AS line, l.place, m.gone IS NOT NULL AS is_solid, coalesce(m.gone, FALSE) AS is_gone,
         coalesce(m.gone, coalesce(last_value(m.gone IGNORE NULLS) OVER before, FALSE) AND coalesce(first_value(m.gone IGNORE NULLS) OVER after, FALSE)) AS cut
  FROM lines l LEFT JOIN marked m ON l.doc_id = m.doc_id AND l.place = m.place
  WINDOW before AS (PARTITION BY l.doc_id ORDER BY l.place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), after AS (PARTITION BY l.doc_id ORDER BY l.place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(sum(CASE WHEN is_solid THEN 1 ELSE 0 END) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN is_gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, '' ORDER BY place) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM placed GROUP BY doc_id
"""
