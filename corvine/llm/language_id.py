"""Language identification by words first, character n-grams for words that aren't known.

A known word adds its log frequency in each language. A word that was never learned falls back to
the longest n-grams of it that were, four letters down to one, and adds the mean of their log
frequencies. A document's language is the one with the largest sum, its score the softmax share.

The model is fitted in Spark on a bounded sample of labelled rows: about SAMPLE_ROWS documents of
each language, chosen by a hash of their doc_id, so that a rare language is learned as well as a
common one; shares of languages are counted over all rows. Everything that the sample holds is kept,
as sorted hashes and, for each, the languages that have it; the model is broadcast, and its size is
bounded by the sample's. Prediction reads each whole text once, in NumPy, without any shuffle.

Cases: `und` with score 0 if a text is null or has no letter (of Unicode's letter categories); a
text with letters of which nothing was learned gets the most frequent language; ties go to the
language that sorts first; with nothing to learn from everything is `und`; rows that repeat are
predicted one by one; a null lang or text isn't learned from; texts of any length are read whole;
an empty table gives an empty result; `keep_identified` keeps all columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import in_python, table

#: Labelled rows of each language that are learned from, about.
SAMPLE_ROWS = 2_000
LONGEST = 4
#: Add this to each count.
SMOOTH = 0.5
_TABLE = 0x20000
LETTERS = bs.Hasher(bs.BASE, 7)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of code points: whether they are letters; a 64-bit word for the lower-case form."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(_TABLE)]
    low = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], dtype=np.uint64)
    return np.array([c.isalpha() for c in chars]), bs.mix(low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))


def letter_words(piece: bs.Piece) -> tuple[Callable, np.ndarray, np.ndarray, np.ndarray]:
    """A hash of any of a piece's slices; starts and ends of runs of letters; the text each run is in."""
    alpha, value = _letters()
    points = np.frombuffer(piece.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    begins = np.concatenate(([0], np.cumsum((piece.data & 0xC0) != 0x80)))
    low = np.minimum(points, _TABLE - 1)
    belongs = alpha[low]
    high = np.flatnonzero(points >= _TABLE)
    if len(high):
        kinds, which = np.unique(points[high], return_inverse=True)
        belongs[high] = np.array([chr(c).isalpha() for c in kinds.tolist()])[which]
    chars = bs.Piece(points, begins[piece.offsets], piece.first)
    start, end, of = bs.word_bounds(chars, belongs, np.arange(len(points)))
    values = value[low] + (points >= _TABLE) * points.astype(np.uint64)
    sums = LETTERS.sums(values) if len(values) <= 2 * bs.PIECE else None
    hashes = lambda a, b: LETTERS.of(values, a, b) if sums is None else LETTERS.slices(sums, a, b)
    return hashes, start, end, np.repeat(np.arange(len(piece)), np.diff(of))


def grams(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of words start:end, all n-grams: the word each is of, and where it starts."""
    room = np.maximum(end - start - n + 1, 0)
    owner = np.repeat(np.arange(len(start)), room)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room) + start[owner]


def _counts(batches):
    """lang, n (0: whole words), hash and count, summed up within the batch."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        for piece in bs.pieces(batch.column("text")):
            hashes, start, end, text = letter_words(piece)
            for n in range(LONGEST + 1):
                owner, at = (np.arange(len(start)), start) if n == 0 else grams(start, end, n)
                h = hashes(at, end if n == 0 else at + n)
                lang = code[piece.first + text[owner]]
                order = np.lexsort((lang, h))
                h, lang = h[order], lang[order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])))) if len(h) else np.zeros(0, dtype=int)
                count = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([names[i] for i in lang[first]], pa.string()), "n": pa.array(np.full(len(first), n), pa.int32()), "hash": pa.array(h[first].view(np.int64)), "count": pa.array(count, pa.int64())})


class Table:
    """Sorted hashes; of each, the languages that have it (`lang` from `start` on) and how far its log frequency is above `base`, that of hashes without a count."""

    def __init__(self, hashes: np.ndarray, lang: np.ndarray, count: np.ndarray, langs: int):
        """One entry for each hash and language, sorted by both."""
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        self.keys, self.start = hashes[first], np.append(first, len(hashes))
        self.lang, self.above = lang.astype(np.int32), np.log((count + SMOOTH) / SMOOTH).astype(np.float32)
        total = np.bincount(lang, weights=count, minlength=langs)
        self.base = np.log(SMOOTH / (total + SMOOTH * len(first)))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which of h are known; of those, one after another: the number among the known, the language and what it adds."""
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == h
        rows = at[known]
        many = self.start[rows + 1] - self.start[rows]
        which = np.repeat(np.arange(len(rows)), many)
        place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.start[rows][which]
        return known, which, self.lang[place], self.above[place]


class LanguageModel:
    """langs; prior: log shares; tables[n]: of n-grams, 0 for whole words."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: dict[int, Table]):
        self.langs, self.prior, self.tables = langs, prior, tables

    @classmethod
    def fit(cls, docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
        """From doc_id, text and lang. Of a language, the sample is the rows whose hash is below sample_rows / its rows."""
        docs = docs.select("doc_id", "text", "lang").where("lang is not null")
        sizes = docs.groupBy("lang").agg(F.count("*").alias("rows")).toArrow().sort_by("lang")
        langs = sizes.column("lang").to_pylist()
        rows = np.array(sizes.column("rows").to_pylist(), dtype=float)
        below = docs.sparkSession.createDataFrame([(x, int(min(1.0, sample_rows / n) * (1 << 30))) for x, n in zip(langs, rows.tolist(), strict=True)], "lang string, below long")
        chosen = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) < F.col("below")
        sample = docs.join(F.broadcast(below), "lang").where(chosen & F.col("text").isNotNull()).select("lang", "text")
        counts = sample.transform(in_python, _counts, "lang string, n int, hash long, count long").groupBy("n", "hash", "lang").agg(F.sum("count").alias("count")).toArrow()
        if not len(counts):
            return cls([], np.zeros(0), {})
        code = {x: i for i, x in enumerate(langs)}
        names = counts.column("lang").combine_chunks().dictionary_encode()
        lang = np.array([code[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()]
        n, h, count = (counts.column(c).to_numpy() for c in ("n", "hash", "count"))
        h = h.view(np.uint64)
        order = np.lexsort((lang, h, n))
        n, h, lang, count = n[order], h[order], lang[order], count[order]
        tables = {}
        for i in range(LONGEST + 1):
            a, b = np.searchsorted(n, (i, i + 1))
            if a < b:
                tables[i] = Table(h[a:b], lang[a:b], count[a:b], len(langs))
        return cls(langs, np.log(rows / rows.sum()), tables)

    def predict(self, piece: bs.Piece) -> tuple[list[str], np.ndarray]:
        texts, k = len(piece), len(self.langs)
        hashes, start, end, text = letter_words(piece)
        has = np.bincount(text, minlength=texts) > 0
        if not k:
            return ["und"] * texts, np.zeros(texts)
        total = np.tile(self.prior, (texts, 1))
        for n in (0, *range(LONGEST, 0, -1)):
            if not len(start):
                break
            if n not in self.tables:
                continue
            table = self.tables[n]
            owner, at = (np.arange(len(start)), start) if n == 0 else grams(start, end, n)
            known, which, lang, above = table.look(hashes(at, end if n == 0 else at + n))
            owner = owner[known]
            count = np.bincount(owner, minlength=len(start))
            # Of a word's n-grams the mean counts; a known word is one.
            total += np.bincount(text[count > 0], minlength=texts)[:, None] * table.base
            total += np.bincount(text[owner[which]] * k + lang, weights=above / count[owner[which]], minlength=texts * k).reshape(texts, k)
            rest = count == 0
            start, end, text = start[rest], end[rest], text[rest]
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.langs[i] if ok else "und" for i, ok in zip(best, has, strict=True)], np.where(has, share, 0.0)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for piece in bs.pieces(batch.column("text")):
                lang, score = shared.value.predict(piece)
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").transform(in_python, run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, langs: set[str] | None = None, least: float = 0.5) -> DataFrame:
    """The rows whose language was found with a score of `least` or more and is one of `langs` (any if None), with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            keep = []
            for piece in bs.pieces(batch.column(batch.schema.get_field_index("text"))):
                lang, score = shared.value.predict(piece)
                keep += [x != "und" and s >= least and (langs is None or x in langs) for x, s in zip(lang, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(in_python, run, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, LanguageModel.fit(learnable(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
