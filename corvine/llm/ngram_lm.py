"""Language model scores: an interpolated modified Kneser-Ney model of any order.

Tokens are the lower-cased (A-Z) words of a text and one end; order - 1 starts come before the first.
The default is ORDER words, that is contexts of two.

Words. How often each word occurs is counted by itself, by the words' whole 64-bit hashes: what is said
of single words (n_known, base_score, N and V) doesn't hang on how n-grams are told apart.

Counting. Tasks sort the n-grams of a lot of training texts, count them and send each different one
once, to the task that holds its context's range of hashes; n-grams of the few most frequent contexts
are spread over all ranges by the whole n-gram's hash, so no range grows with one context. A range
adds up its n-grams, stores them and, without their first words, passes them on: the next lower order
counts how many different words come before each of its n-grams. So it goes down to single words.
Each order is counted in PASSES, each over all its n-grams for its share of the ranges, and what one
order passes on is written as a table, so that shuffles hold a part of one order at a time.
Every count comes from all training texts; nothing is pruned.

The model is stored as sorted hash arrays, one file for each order and range, in the shared folder:
contexts with their sums and where their words begin, the words' hashes and counts; contexts that one
word follows, most of all, lie apart with that word and its count. Only sums over all n-grams of an
order (counts of counts, totals) and the spread contexts' sums reach the driver, added up in Spark.

Scoring. Workers memory-map the arrays and look up the different n-grams and contexts of a lot in
sorted order; texts aren't shuffled. Where the shared folder can't be mapped, an array is read into
memory while its range is looked up.

    P(w | u v) = max(c(u v w) - D(c(u v w)), 0) / c(u v) + gamma(u v) P(w | v)
    P(w | v)   = max(n(v w) - D'(n(v w)), 0) / n(v) + gamma'(v) P(w)
    P(w)       = max(n(w) - D''(n(w)), 0) / sum of n + gamma'' / (V + 1)

n counts different words before; an order's D are its three modified Kneser-Ney discounts, gamma what
they leave. After a context without counts, P is that of the next lower order; V + 1 leaves room for
one unknown word, which any unknown word is scored as. In n-grams words are told apart by 48 bits of their
hashes, contexts by 64-bit hashes and the words that follow one by 32 bits.

Cases: a null or wordless text is one end; texts of any length are scored whole; with no training
text at all every token is unknown (N, V and all counts 0); rows that repeat are counted and scored
one by one; a null doc_id isn't held out; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import by_ranges, cuts_folder, discard, durable, in_python, table, width, written
from .exchange import pack, runs_of, unpack

ORDER = 3
#: Parts in which an order is counted.
PASSES = 3
#: Tokens that are counted and scored at once.
COUNTED, SCORED = 1_500_000, 1_500_000
U = np.uint64
#: Bits of a word's hash that are left out, as words travel with n-grams: 48 stay.
WORD_BITS = U(16)
START, END = U(0x5354415254) << WORD_BITS, U(0x454E44) << WORD_BITS
#: Spread contexts whose sums travel together.
BLOCK = 1_024
#: Rows, at least, and for each range, in which frequent contexts are looked for; the least share, in fair shares of a range, of one.
SPREAD_ROWS, ROWS_PER_RANGE, FAIR = 2_000, 8, 0.25
SUMS = ("total", "one", "two", "more")


def token_grams(piece: bs.Piece, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of all n-grams of a piece, first words first, then the last words with all their bits; and the text each is in: one n-gram for each token."""
    w = bs.words(piece)
    counts = w.counts + 1
    of = np.concatenate(([0], np.cumsum(counts)))
    token = np.empty(of[-1], dtype=U)
    doc = np.repeat(np.arange(len(piece)), counts)
    token[np.arange(len(w.hash)) + w.text()] = w.hash
    token[of[1:] - 1] = END
    whole, token = token, token >> WORD_BITS
    place = np.arange(of[-1]) - of[:-1][doc]
    grams = [token]
    for back in range(1, order):
        before = np.full(len(token), START >> WORD_BITS, dtype=U)
        before[back:] = np.where(place[back:] >= back, token[:-back], START >> WORD_BITS)
        grams.append(before)
    return [*grams[::-1], whole], doc


def token_lots(columns, order: int, least: int):
    """Lots of `least` or more tokens: what token_grams gives of their n-grams, the text of each, and the number of texts; a text isn't cut."""
    held, size, texts = [], 0, 0

    def lot():
        return [np.concatenate(x) for x in zip(*(g for g, _ in held), strict=True)], np.concatenate([d for _, d in held]), texts

    for column in columns:
        for piece in bs.pieces(column):
            grams, doc = token_grams(piece, order)
            held.append((grams, doc + texts))
            size, texts = size + len(doc), texts + len(piece)
            if size >= least:
                yield lot()
                held, size, texts = [], 0, 0
    if held:
        yield lot()


def context_hash(words: list[np.ndarray]) -> np.ndarray:
    h = bs.mix(words[0])
    for w in words[1:]:
        h = bs.mix(h * U(0x9E3779B97F4A7C15) ^ w)
    return h


def gram_keys(context: np.ndarray, word: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Keys of n-grams. High halves are their contexts', so that a range holds a context's n-grams together, but for spread contexts."""
    whole = bs.mix(context * U(0x9E3779B97F4A7C15) ^ bs.mix(word))
    key = (context & U(0xFFFFFFFF00000000)) | whole >> U(32)
    if len(spread):
        key = np.where(np.isin(context, spread), whole, key)
    return key


def range_of(key: np.ndarray, n: int) -> np.ndarray:
    """Ascends with the key."""
    return ((key >> U(32)) * U(n) >> U(32)).astype(np.int64)


def small(values: np.ndarray) -> np.ndarray:
    """Numbers in the narrowest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def _packed_words(words: list[np.ndarray]) -> bytes:
    """Different words of some n-grams, as steps, and for each place of the n-grams their numbers."""
    known, which = np.unique(np.concatenate(words), return_inverse=True)
    steps, which = np.diff(known, prepend=U(0)), which.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    return len(known).to_bytes(4, "little") + _zstd()[0].compress(pack(steps) + pack(which))


def _unpacked_words(raw: bytes, order: int) -> list[np.ndarray]:
    n, raw = int.from_bytes(raw[:4], "little"), _zstd()[1].decompress(raw[4:])
    known = np.cumsum(unpack(raw[: 8 * n], U), dtype=U)
    return list(known[unpack(raw[8 * n :], np.uint16 if n <= 1 << 16 else np.uint32)].reshape(order, -1))


def _packed_counts(counts: np.ndarray) -> bytes:
    """Nothing for counts of 1."""
    return b"" if (counts == 1).all() else _zstd()[0].compress(pack(counts.astype(np.uint64)))


def _unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    return unpack(_zstd()[1].decompress(raw), np.uint64).astype(np.int64) if raw else np.ones(n, dtype=np.int64)


COUNTS = "range int, words binary, many binary"
_NAMES = [c.split()[0] for c in COUNTS.split(", ")]
_TYPES = (pa.int32(), *[pa.binary()] * 2)


def _gram_rows(words: list[np.ndarray], key: np.ndarray, n_ranges: int, many: np.ndarray) -> pa.RecordBatch:
    """Rows of COUNTS, one for each range, of n-grams sorted by key, and how often each was counted."""
    place = range_of(key, n_ranges)
    cuts = np.append(runs_of(place), len(place))
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        rows.append((int(place[a]), _packed_words([w[a:b] for w in words]), _packed_counts(many[a:b])))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, ascending, a place of each, and for each place its key's number."""
    order = np.argsort(key)
    key = key[order]
    new = runs_of(key)
    number = np.zeros(len(key), dtype=np.int64)
    number[new] = 1
    which = np.empty(len(key), dtype=np.int64)
    which[order] = np.cumsum(number) - 1
    return key[new], order[new], which


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order in which the first places of different keys come ascending, and each key's sums."""
    order = np.argsort(key)
    key = key[order]
    new = runs_of(key)
    return order[new], key[new], *(np.add.reduceat(v[order], new) for v in values)


def _count(order: int, spread: np.ndarray, n_ranges: int, ranges: range):
    """Rows of COUNTS of the n-grams that fall into `ranges`."""

    def run(batches):
        for (*words, _), _, _ in token_lots((b.column("text") for b in batches), order, COUNTED):
            key = gram_keys(context_hash(words[:-1]), words[-1], spread) if order > 1 else bs.mix(words[-1])
            place = range_of(key, n_ranges)
            mine = np.flatnonzero((place >= ranges[0]) & (place <= ranges[-1]))
            first, key, many = _summed(key[mine], np.ones(len(mine), dtype=np.int64))
            if len(key):
                yield _gram_rows([w[mine[first]] for w in words], key, n_ranges, many)

    return run


def _count_words(n_ranges: int):
    """Rows of COUNTS of single words with all their bits, which are their keys."""

    def run(batches):
        for (_, whole), _, _ in token_lots((b.column("text") for b in batches), 1, COUNTED):
            _, key, many = _summed(whole, np.ones(len(whole), dtype=np.int64))
            yield _gram_rows([key], key, n_ranges, many)

    return run


def _words(shelf: Shelf):
    """Stores ranges of words, from rows of COUNTS sorted by range; of each range, its tokens and its different words."""

    def run(batches):
        now, parts = None, []

        def finish():
            _, key, seen = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            shelf.write("word", now, key=key, seen=small(seen))
            return pa.RecordBatch.from_arrays([pa.array([int(seen.sum())]), pa.array([len(key)])], names=["tokens", "words"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != now:
                    if parts:
                        yield finish()
                    now, parts = r["range"], []
                (key,) = _unpacked_words(r["words"], 1)
                parts.append((key, _unpacked_counts(r["many"], len(key))))
        if parts:
            yield finish()

    return run


#: Files that a worker keeps mapped, whatever the number of ranges and orders. Each holds a descriptor.
MAPS = 128


class Shelf:
    """Arrays stored by name and range in one folder that all executors reach; read by memory-mapping."""

    def __init__(self, uri: str, n_ranges: int):
        self.uri, self.n_ranges = uri, n_ranges

    def _where(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else "file://" + os.path.abspath(self.uri))

    def write(self, name: str, i: int, **arrays: np.ndarray) -> None:
        """A range's arrays, one file: a line that says what follows, then each from a multiple of 8 bytes on. A repeated task writes the same bytes again and moves them into place at once."""
        fs, root = self._where()
        fs.create_dir(root, recursive=True)
        head = json.dumps({k: [a.dtype.str, len(a)] for k, a in arrays.items()}).encode()
        head += b" " * (-(len(head) + 1) % 8) + b"\n"
        part = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(head)
            for a in arrays.values():
                raw = np.ascontiguousarray(a).tobytes()
                f.write(raw + b"\0" * (-len(raw) % 8))
        fs.move(part, f"{root}/{name}-{i}")

    def read(self, name: str, i: int) -> dict[str, np.ndarray]:
        """A range's arrays; none if nothing was stored."""
        return self._mapped(name, i) if isinstance(self._where()[0], pafs.LocalFileSystem) else self._views(self._bytes(name, i))

    @lru_cache(maxsize=MAPS)  # noqa: B019  one shelf a worker and model; a mapping that is dropped here closes its file
    def _mapped(self, name: str, i: int) -> dict[str, np.ndarray]:
        path = f"{self._where()[1]}/{name}-{i}"
        return self._views(np.memmap(path, dtype=np.uint8, mode="r") if os.path.exists(path) else np.zeros(0, dtype=np.uint8))

    def _bytes(self, name: str, i: int) -> np.ndarray:
        fs, root = self._where()
        if fs.get_file_info(f"{root}/{name}-{i}").type == pafs.FileType.NotFound:
            return np.zeros(0, dtype=np.uint8)
        with fs.open_input_stream(f"{root}/{name}-{i}") as f:
            return np.frombuffer(f.read(), dtype=np.uint8)

    @staticmethod
    def _views(raw: np.ndarray) -> dict[str, np.ndarray]:
        if not len(raw):
            return {}
        at = int(np.flatnonzero(raw[:4096] == 10)[0]) + 1
        out = {}
        for k, (kind, n) in json.loads(raw[:at].tobytes()).items():
            size = n * np.dtype(kind).itemsize
            out[k] = raw[at : at + size].view(kind)
            at += size + -size % 8
        return out

    def look(self, name: str, keys: np.ndarray, values: tuple[str, ...]) -> list[np.ndarray]:
        """For ascending keys, the values stored with them, 0 if there are none."""
        out = [np.zeros(len(keys), dtype=np.int64) for _ in values]
        place = range_of(keys, self.n_ranges)
        cuts = np.append(runs_of(place), len(place))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            stored = self.read(name, int(place[a]))
            if not stored or not len(stored["key"]):
                continue
            known = stored["key"]
            hit, at = _found(known, keys[a:b])
            for o, k in zip(out, values, strict=True):
                o[a + hit] = stored[k][at]
        return out

    def look_grams(self, name: str, keys: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For n-grams by ascending key, with their contexts: their counts and their contexts' SUMS, 0 if there are none. A spread context's sums are one range's."""
        count, sums = np.zeros(len(keys), dtype=np.int64), np.zeros((4, len(keys)), dtype=np.int64)
        place = range_of(keys, self.n_ranges)
        cuts = np.append(runs_of(place), len(place))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            stored = self.read(name, int(place[a]))
            if not stored:
                continue
            context, word = contexts[a:b], keys[a:b].astype(np.uint32)
            hit, at = _found(stored["lone"], context)
            many = stored["lone_many"][at].astype(np.int64)
            count[a + hit] = np.where(stored["lone_word"][at] == word[hit], many, 0)
            sums[:, a + hit] = many, many == 1, many == 2, many > 2
            hit, at = _found(stored["key"], context)
            for o, k in zip(sums, SUMS, strict=True):
                o[a + hit] = stored[k][at]
            there, at = _found_within(stored["word"], stored["first"][at], stored["first"][at + 1], word[hit])
            count[a + hit[there]] = stored["many"][at]
        return count, sums


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among ascending known ones, and where."""
    if not len(known):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    hit = np.flatnonzero(known[at] == keys)
    return hit, at[hit]


def _found_within(known: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, each key among its own stretch [low, high) of known ones, ascending within it and not empty."""
    low, last = low.astype(np.int64), high.astype(np.int64) - 1
    high = last.copy()
    while len(todo := np.flatnonzero(low < high)):
        middle = (low[todo] + high[todo]) // 2
        less = known[middle] < keys[todo]
        low[todo[less]] = middle[less] + 1
        high[todo[~less]] = middle[~less]
    hit = np.flatnonzero(known[low] == keys) if len(low) else low
    return hit, low[hit]


STATS = "kind int, order int, context long, " + ", ".join(f"{c} long" for c in (*SUMS, "four"))
_STAT_NAMES = [c.split()[0] for c in STATS.split(", ")]


def _stat_rows(kind: int, order: int, context: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Kind 1: a range's numbers of n-grams that are counted once, twice, three, four and more times. Kind 3: a range of words' total."""
    n = len(context)
    cols = [pa.array(c.astype(np.int64)) for c in (*columns, *[np.zeros(n)] * (5 - len(columns)))]
    return pa.RecordBatch.from_arrays([*[pa.array(np.full(n, x, dtype=np.int32)) for x in (kind, order)], pa.array(context.view(np.int64)), *cols], names=_STAT_NAMES)


def _stored(shelf: Shelf, order: int, spread: np.ndarray, i: int, parts: list) -> tuple:
    """Adds up and stores a range's n-grams of an order and their contexts; returns the n-grams' words and rows of STATS or blocks of spread contexts' sums."""
    words = [np.concatenate([p[0][j] for p in parts]) for j in range(order)]
    many = np.concatenate([p[1] for p in parts])
    context = context_hash(words[:-1]) if order > 1 else None
    key = gram_keys(context, words[-1], spread) if order > 1 else bs.mix(words[-1])
    first, key, many = _summed(key, many)
    words = [w[first] for w in words]
    counts = [int((many == c).sum()) for c in (1, 2, 3, 4)]
    stats = [_stat_rows(1, order, np.zeros(1, dtype=U), *[np.array([c]) for c in (*counts, int((many > 4).sum()))])]
    if order == 1:
        shelf.write("gram1", i, key=key, many=small(many))
        stats.append(_stat_rows(3, order, np.zeros(1, dtype=U), np.array([many.sum()])))
        return words, stats
    context, word = context[first], key.astype(np.uint32)
    by = np.lexsort((word, context)) if np.isin(context, spread).any() else np.argsort(context, kind="stable")
    context, word, counted = context[by], word[by], many[by]
    heads = runs_of(context)
    sums = [np.add.reduceat(x, heads) for x in (counted, (counted == 1) * 1, (counted == 2) * 1, (counted > 2) * 1)]
    context, size = context[heads], np.diff(np.append(heads, len(word)))
    lone, several = heads[size == 1], np.repeat(size > 1, size)
    starts = np.concatenate(([0], np.cumsum(size[size > 1]))).astype(np.uint32)
    shelf.write(
        f"gram{order}", i, lone=context[size == 1], lone_word=word[lone], lone_many=small(counted[lone]),
        key=context[size > 1], first=starts, word=word[several], many=small(counted[several]), **{k: small(s[size > 1]) for k, s in zip(SUMS, sums, strict=True)},
    )
    hot = np.flatnonzero(np.isin(context, spread))
    at = np.searchsorted(spread, context[hot])
    for block in np.unique(at // BLOCK).tolist():
        own = at // BLOCK == block
        told = np.zeros((4, BLOCK), dtype=np.int64)
        told[:, at[own] % BLOCK] = [s[hot[own]] for s in sums]
        stats.append((block, told.tobytes()))
    return words, stats


PASSED = f"{COUNTS}, {STATS}"
_ALL = [*_NAMES, *_STAT_NAMES]
_STAT_TYPES = (pa.int32(), pa.int32(), *[pa.int64()] * 6)


def _ranges(shelf: Shelf, order: int, spread: np.ndarray, below: np.ndarray):
    """From rows of COUNTS, sorted by range, rows of STATS, and of COUNTS of the next lower order, of many ranges together."""

    def told(stats):
        """Of kind 2: a block of spread contexts, its number as `context`, their sums in the range as `words`."""
        for s in stats:
            if isinstance(s, tuple):
                row = dict.fromkeys(_ALL) | {"kind": 2, "order": order, "context": s[0], "words": s[1]}
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in zip(_ALL, (*_TYPES, *_STAT_TYPES), strict=True)], names=_ALL)
                continue
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(s), t) for t in _TYPES], *s.columns], names=_ALL)

    def passed_on(held):
        words = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        key = gram_keys(context_hash(words[:-1]), words[-1], below) if order > 2 else bs.mix(words[-1])
        first, key, many = _summed(key, np.ones(len(key), dtype=np.int64))
        rows = _gram_rows([w[first] for w in words], key, shelf.n_ranges, many)
        return pa.RecordBatch.from_arrays([*rows.columns, *[pa.nulls(len(rows), t) for t in _STAT_TYPES]], names=_ALL)

    def run(batches):
        now, parts, held = None, [], []

        def finish():
            words, stats = _stored(shelf, order, spread, now, parts)
            if order > 1:
                held.append(words[1:])
            yield from told(stats)
            if sum(len(h[0]) for h in held) >= COUNTED:
                yield passed_on(held)

        for batch in batches:
            for r in batch.to_pylist():
                if r["range"] != now:
                    if parts:
                        yield from finish()
                    now, parts = r["range"], []
                words = _unpacked_words(r["words"], order)
                parts.append((words, _unpacked_counts(r["many"], len(words[0]))))
        if parts:
            yield from finish()
        if held:
            yield passed_on(held)

    return run


def _added(batches):
    """Sums of blocks by their numbers."""
    sums = {}
    for batch in batches:
        for block, raw in zip(batch.column("range").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(raw, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["range", "sums"])


def discounts(tally: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and more. Where counts of counts are missing, half of each count's unit."""
    n1, n2, n3, n4 = tally
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0, *[min(max(x, 0.0), float(i)) for i, x in enumerate(d, 1)]])


@dataclass
class NgramModel:
    """What workers need besides the stored arrays. Of each order from 1: its discounts; from 2: its spread contexts (sorted) and their sums."""

    shelf: Shelf
    order: int
    discounts: dict[int, np.ndarray]
    spread: dict[int, np.ndarray]
    spread_sums: dict[int, np.ndarray]
    tokens: int
    words: int
    pairs: int
    word_gamma: float

    @classmethod
    def fit(cls, texts: DataFrame, order: int = ORDER) -> NgramModel:
        """From the column text of the training rows."""
        spark = texts.sparkSession
        n = width(spark)
        shelf = Shelf(f"{cuts_folder(spark)}/lm-{uuid.uuid4().hex}", n)
        spread = frequent_contexts(texts, order, shelf.n_ranges)
        none = np.zeros(0, dtype=U)
        texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
        counted, folder = written(by_ranges(texts.transform(in_python, _count_words(n), COUNTS), "range").transform(in_python, _words(shelf), "tokens long, words long"))
        tokens, words = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words")]).first()
        discard(spark, folder)
        above, folders, added = None, [], []
        sums = {k: np.zeros((4, len(spread[k])), dtype=np.int64) for k in spread}
        for k in range(order, 0, -1):
            own, below = spread.get(k, none), spread.get(k - 1, none)
            cuts = []
            for ranges in filter(None, (range(i * n // PASSES, (i + 1) * n // PASSES) for i in range(PASSES))):
                counts = texts.transform(in_python, _count(order, own, shelf.n_ranges, ranges), COUNTS) if k == order else above.where(F.col("range").between(ranges[0], ranges[-1])).select(*_NAMES)
                cuts.append(written(by_ranges(counts, "range").transform(in_python, _ranges(shelf, k, own, below), PASSED)))
            for folder in folders:
                discard(spark, folder)
            above, folders = reduce(DataFrame.union, (c for c, _ in cuts)), [f for _, f in cuts]
            if len(own):
                blocks = above.where("kind = 2").select(F.col("context").cast("int").alias("range"), F.col("words").alias("sums"))
                for r in by_ranges(blocks, "range").transform(in_python, _added, "range int, sums binary").collect():
                    sums[k][:, r.range * BLOCK : (r.range + 1) * BLOCK] = np.frombuffer(r.sums, dtype=np.int64).reshape(4, -1)[:, : len(own) - r.range * BLOCK]
            added += above.where("kind <> 2").groupBy("kind", "order").agg(*[F.sum(c).alias(c) for c in (*SUMS, "four")]).collect()
        for folder in folders:
            discard(spark, folder)
        tallies, pairs = {k: [0] * 5 for k in range(1, order + 1)}, 0
        for r in added:
            if r.kind == 1:
                tallies[r.order] = [r.total, r.one, r.two, r.more, r.four]
            else:
                pairs = r.total
        d = {k: discounts(t[:4]) for k, t in tallies.items()}
        t = tallies[1]
        gamma = float(d[1][1] * t[0] + d[1][2] * t[1] + d[1][3] * (t[2] + t[3] + t[4])) / pairs if pairs else 1.0
        return cls(shelf, order, d, spread, sums, tokens, words, pairs, gamma)

    def score(self, words: list[np.ndarray], doc: np.ndarray, texts: int) -> dict[str, np.ndarray]:
        """Of each text of a lot, what SCORES has."""
        *words, whole = words
        whole, _, at = _distinct(whole)
        (seen,) = self.shelf.look("word", whole, ("seen",))
        known, many = bs.mix(whole >> WORD_BITS), np.zeros(len(whole), dtype=np.int64)
        by = np.argsort(known)
        (many[by],) = self.shelf.look("gram1", known[by], ("many",))
        base = np.log10((seen + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        kept = np.maximum(many - self.discounts[1][np.minimum(many, 3)], 0) / max(self.pairs, 1)
        p = (kept + self.word_gamma / (self.words + 1))[at]
        for k in range(2, self.order + 1):
            spread = self.spread.get(k, np.zeros(0, dtype=U))
            context = context_hash(words[-k:-1])
            grams, one, gram = _distinct(gram_keys(context, words[-1], spread))
            heads = context[one]
            count, sums = self.shelf.look_grams(f"gram{k}", grams, heads)
            hot = np.flatnonzero(np.isin(heads, spread))
            if len(hot):
                sums[:, hot] = self.spread_sums[k][:, np.searchsorted(spread, heads[hot])]
            total, d = np.maximum(sums[0], 1), self.discounts[k]
            gamma = np.where(sums[0] > 0, (d[1:] @ sums[1:]) / total, 1.0)
            kept = np.maximum(count - d[np.minimum(count, 3)], 0)
            p = (kept / total)[gram] + gamma[gram] * p
        return {
            "n_tokens": np.bincount(doc, minlength=texts),
            "n_known": np.bincount(doc, weights=seen[at] > 0, minlength=texts).astype(np.int64),
            "base_score": np.bincount(doc, weights=base[at], minlength=texts),
            "score": np.bincount(doc, weights=np.log10(p), minlength=texts),
        }


def frequent_contexts(texts: DataFrame, order: int, n_ranges: int) -> dict[int, np.ndarray]:
    """Of each order from 2, hashes of contexts that take more than FAIR / n_ranges of a sample's tokens: n_ranges / FAIR at most.

    They only decide where n-grams are counted, not what is counted; the sample grows with the ranges.
    """

    def run(batches):
        for (*words, _), *_ in token_lots((b.column("text") for b in batches), order, SCORED):
            for k in range(2, order + 1):
                h, n = np.unique(context_hash(words[-k:-1]), return_counts=True)
                often = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()) + 1, k, dtype=np.int32)), pa.array(np.append(h[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)), pa.array(np.append(np.zeros(int(often.sum()), dtype=np.int64), len(words[-1])))], names=["k", "context", "n", "tokens"])

    rows = texts.count()
    share = min(1.0, max(SPREAD_ROWS, ROWS_PER_RANGE * n_ranges) / max(rows, 1))
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))
    counted = texts.where(chosen).select("text").transform(in_python, run, "k int, context long, n long, tokens long").groupBy("k", "context").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    counted = durable(counted)
    totals = counted.groupBy("k").agg(F.sum("tokens").alias("all"))
    found = counted.where("n > 0").join(F.broadcast(totals), "k").where(F.col("n") > FAIR * F.col("all") / n_ranges).select("k", "context").collect()
    return {k: np.sort(np.array([r.context for r in found if r.k == k], dtype=np.int64).view(U)) for k in range(2, order + 1)}


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: NgramModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10) of each row; perplexity is 10 ** (-score / n_tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            parts = [shared.value.score(*lot) for lot in token_lots([batch.column("text")], shared.value.order, SCORED)]
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in ("n_tokens", "n_known", "base_score", "score")]
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").transform(in_python, run, SCORES)


def op6_ngram_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = NgramModel.fit(docs.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
