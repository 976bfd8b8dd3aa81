"""Families of sorted arrays where keys of different contents collide."""

import numpy as np

from corvine.llm import exchange, suffix_dedup
from corvine.llm import bytescan as bs


def test_colliding_keys():
    rng = np.random.default_rng(1)
    for _ in range(50):
        family, first, many, added = exchange.Family(), {}, {}, []
        for batch in rng.permutation(6).tolist():
            rows = sorted({(int(k), int(c)) for k, c in zip(rng.integers(0, 6, 8), rng.integers(0, 3, 8), strict=True)})
            docs = rng.integers(0, 100, len(rows)) * 6 + batch
            family.add(np.array([k for k, _ in rows], dtype=np.uint64), np.array([c for _, c in rows], dtype=np.uint32), docs)
            for r, d in zip(rows, docs.tolist(), strict=True):
                first[r], many[r] = min(d, first.get(r, d)), many.get(r, 0) + 1
                added.append((r, d))
        flags = family.flags[: family.slots]
        assert [bool(f & exchange.LATER) for f in flags] == [d > first[r] for r, d in added]
        # What was the smallest until a smaller one came may not be told that it's shared, but is told that it's later.
        assert [bool(f) for f in flags] == [many[r] > 1 for r, _ in added]


def test_strings_of_frequent_grams_go_by_themselves():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 122, 40, dtype=np.uint8)) + b" " * 60 + bytes(rng.integers(97, 122, 40, dtype=np.uint8)) for _ in range(20)]
    piece = bs.Piece(np.frombuffer(b"".join(texts), dtype=np.uint8), np.arange(21) * 140, 0)
    g = suffix_dedup.Grams(piece)
    key = bs.BYTES.of(piece.data, g.at, g.at + suffix_dedup.GRAM)
    values, counts = np.unique(key, return_counts=True)
    hot = np.sort(values[counts >= 20])
    ords = [(g.at[g.doc == d] - 140 * d).astype(np.uint32).tobytes() for d in range(20)]
    key, doc, first, last = suffix_dedup._stretches(piece, ords)
    many = last - first + 1
    order = np.argsort(key, kind="stable")
    parts = [x[order] for x in (key, doc, first - 140 * doc, many, first)]
    split = suffix_dedup._singly(hot, *parts, piece.data)
    assert len(hot) and split[3].sum() == many.sum() and not np.isin(split[0], hot).any() and (np.diff(split[0].astype(object)) >= 0).all()
    strings = lambda x: sorted((int(d), int(s) + j, texts[int(d)][int(s) + j : int(s) + j + 50]) for d, s, m in zip(x[1], x[2], x[3], strict=True) for j in range(int(m)))
    assert strings(split) == strings(parts)
    assert all(piece.data[a : a + 50].tobytes() == texts[int(d)][int(s) : int(s) + 50] for d, s, a in zip(split[1], split[2], split[4], strict=True))
