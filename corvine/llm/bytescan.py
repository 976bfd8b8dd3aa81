"""Words, hashes and windows of whole Arrow text columns at once, on NumPy arrays of UTF-8 bytes.

Every separator used here is ASCII, so cutting bytes and cutting characters give the same words.
Hashes are 64-bit polynomials over a randomised byte alphabet, finished by a bijective mixer; words longer
than SHORT bytes have BLAKE2 hashes. The same bytes give the same hash in any batch, process or run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes worked on at once: what NumPy makes of them stays in the CPU's cache. A longer text is one piece.
PIECE = 1 << 18
#: Bytes of words that are hashed by polynomials. Of 1,024 bytes and more, texts made for it (Thue-Morse words) collide in any polynomial modulo 2**64.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, a bijection on 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def alphabet(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True where a byte belongs to a word: anything but blanks, and letters or digits only.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[123 + 5 :] = True


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, PIECE // 4, min(2 * len(self.up), 2 * PIECE + 1))
            step = np.full(size, self.base, dtype=U)
            step[0] = 1
            back = np.full(size, self.inverse, dtype=U)
            back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up, self.down


@cache
def powers_of(base: int) -> Powers:
    """Hashers of one base share its powers."""
    return Powers(base)


class Hasher:
    """Hashes of any slices of one array, from its prefix sums."""

    def __init__(self, base: int, seed: int = 0):
        self.powers, self.letters = powers_of(base), alphabet(seed)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of bytes, or of 64-bit words as they are."""
        up, _ = self.powers.upto(len(values))
        out = np.zeros(len(values) + 1, dtype=U)
        np.cumsum((self.letters[values] if values.dtype == np.uint8 else values) * up[: len(values)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.powers.upto(len(sums))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))

    def of(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of slices; start must ascend. Of a long array, prefix sums are made for a part at a time."""
        if len(values) <= 2 * PIECE:
            return self.slices(self.sums(values), start, end)
        out, i = np.empty(len(start), dtype=U), 0
        while i < len(start):
            j = int(np.searchsorted(start, start[i] + PIECE))
            low = int(start[i])
            out[i:j] = self.slices(self.sums(values[low : int(end[i:j].max())]), start[i:j] - low, end[i:j] - low)
            i = j
        return out


BASE = 0xD6E8FEB86659FD93
BYTES = Hasher(BASE)
WORDS = Hasher(0xA0761D6478BD642F)


@dataclass
class Piece:
    """Some texts of a batch: their bytes, one after another, where each begins, and the number of the first."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """Text columns as pieces of about `size` bytes, cut between texts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and len(raw) else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield Piece(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def unpacked(column: pa.Array, decompress, size: int = PIECE) -> Iterator[Piece]:
    """Pieces of compressed texts."""
    held, total, first = [], 0, 0
    for i, x in enumerate(column):
        held.append(decompress(x.as_buffer()))
        total += len(held[-1])
        if total >= size or i + 1 == len(column):
            yield Piece(np.frombuffer(b"".join(held), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int64), first)
            held, total, first = [], 0, i + 1


def order_within(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by group, then by key; groups are small numbers, so the second sort is a radix sort."""
    order = np.argsort(key)
    small = group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group
    return order[np.argsort(small[order], kind="stable")]


def order_by(key: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Order by key, then by rest; fast where few keys are equal."""
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    at = np.flatnonzero(same[1:] | same[:-1])
    if len(at):
        some = order[at]
        order[at] = some[np.lexsort((*(r[some] for r in rest[::-1]), key[some]))]
    return order


@dataclass
class Words:
    """start, end: byte ranges of the words; of[i]: first word of text i; hash: of the lower-cased words."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def text(self) -> np.ndarray:
        """For each word, the text it is in."""
        return np.repeat(np.arange(len(self.of) - 1), self.counts)


def word_bounds(piece: Piece, belongs: np.ndarray, lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = belongs[lowered]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = piece.offsets[:-1][np.diff(piece.offsets) > 0]
    before[full] = False
    if len(full):
        after[np.append(full[1:], len(inside)) - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, piece.offsets)


def words(piece: Piece, belongs: np.ndarray = NOT_BLANK) -> Words:
    lowered = LOWER[piece.data]
    start, end, of = word_bounds(piece, belongs, lowered)
    hashes = BYTES.of(lowered, start, end)
    for i in np.flatnonzero(end - start > SHORT).tolist():
        hashes[i] = int.from_bytes(blake2b(lowered[start[i] : end[i]].data, digest_size=8).digest(), "little")
    return Words(start, end, of, hashes)


def windows(w: Words, k: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of k words that stay within a text."""
    n = len(w.start)
    if n < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    room = np.repeat(w.of[1:], w.counts)[: n - k + 1] - np.arange(n - k + 1) >= k
    at = np.flatnonzero(room)
    return at, WORDS.slices(WORDS.sums(w.hash) if sums is None else sums, at, at + k)


def spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True: their starts and ends."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def spread(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of n places, those that some range start:end covers."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0
