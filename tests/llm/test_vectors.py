"""Hard negatives and whitening against brute force, and vectors that can't take part."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvine.llm import hard_negatives, vectors, whitening

NAN, INF = float("nan"), float("inf")
COLUMNS = "vec_id long, label int, embedding array<float>, score string, x string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "x", "i") for r in rows], COLUMNS).repartition(3)


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for top in (3, 100, 1000, 1 << 20, 1 << 40):
        m = rng.integers(-top, top, (50, 7))
        m[0] = [-128, 127, 0, 0, 0, 0, 0]
        m[1] = [-129, 127, 0, 0, 0, 0, 0]
        packed = vectors.pack(m)
        assert (vectors.unpack(packed, 7) == m).all() and (vectors.unpack(packed.slice(3), 7) == m[3:]).all()
        assert len(packed[0].as_py()) == 8 and len(packed[1].as_py()) == 15
    assert len(vectors.pack(np.zeros((0, 4), dtype=np.int64))) == 0 and len(vectors.unpack(pa.array([], pa.binary()), 4)) == 0


def hard_by_loop(rows, anchors, positives=5, negatives=5):
    rows = {i: (lab, [math.floor(256 * e) for e in v]) for i, lab, v in rows}
    out = []
    for a in filter(anchors, rows):
        lab, x = rows[a]
        score = {i: sum(p * q for p, q in zip(x, y, strict=True)) for i, (_, y) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == lab][:positives]:
            band = [i for i in order if rows[i][0] != lab and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(band[:negatives])]
    return sorted(out)


def planted_vectors(n, dim, seed, labels=4):
    """A third of all rows are copies of one vector, the rest lie around a few centres; many equal scores."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    hot = [rng.gauss(0, 0.5) for _ in range(dim)]
    return [(i, rng.choice([0, 0, *range(labels)]), [float(np.float32(e)) for e in (hot if i % 3 == 0 else [c + rng.choice([0, 0.02, 0.3]) * rng.gauss(0, 1) for c in rng.choice(centres)])]) for i in range(n)]


@pytest.mark.parametrize("slice_rows, chunk, leaf", [(64, 8, 5)])
def test_hard_negatives(spark, monkeypatch, slice_rows, chunk, leaf):
    for name, value in {"SLICE": slice_rows, "CHUNK": chunk, "LEAF": leaf, "ANCHOR_LEAF": 3, "LEAST": slice_rows // 4, "DEPTH": 4}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = planted_vectors(400, 6, 3)
    got = hard_negatives.mine(frame(spark, rows), "vec_id", "label", "embedding", F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == hard_by_loop(rows, lambda i: i % 10 == 0)


def test_hard_negatives_prune():
    """Clusters far apart: most pairs are never scored, and the result is that of all pairs."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 1000
    x = np.floor(centres[rng.integers(12, size=4000)] + rng.normal(size=(4000, 8)) * 5)
    labels, ids = rng.integers(3, size=4000), np.arange(4000)
    order, cuts = hard_negatives.leaf_order(x, 64)
    asks, ends = hard_negatives.leaf_order(x[:200], 8)
    low, high = np.full((200, 1), hard_negatives.LOW), np.full((200, 1), hard_negatives.HIGH)
    for same in (True, False):
        found, scored = hard_negatives.dual_search(hard_negatives.Tree(x[asks], labels[asks], ends), ids[asks], low, high, hard_negatives.Tree(x[order], labels[order], cuts), ids[order], same, 5)
        assert scored < 200 * 4000 // 5
        s = (x[asks] @ x.T).astype(np.int64)
        want = []
        for r, a in enumerate(asks.tolist()):
            fits = [i for i in range(4000) if (labels[i] == labels[a]) == same and (not same or i != a)]
            want += [(r, 0, i, int(s[r, i])) for i in sorted(fits, key=lambda i: (-s[r, i], i))[:5]]
        assert sorted(zip(*(f.tolist() for f in found), strict=True)) == sorted(want)


def test_hard_negatives_large_entries(spark):
    rows = [(i, i % 2, [float(1 << 20) * (i % 5 + 1), 3.0 * i]) for i in range(12)]
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), "vec_id", "label", "embedding", F.col("vec_id") % 4 == 0).collect())) == hard_by_loop(rows, lambda i: i % 4 == 0)


UNUSABLE = [(1, 0, None), (2, 0, [1.0, None]), (3, 0, [NAN, 1.0]), (4, 0, [INF, 1.0]), (5, None, [1.0, 1.0]), (None, 0, [1.0, 1.0]), (6, 0, [1.0, 1.0, 1.0]), (7, 0, []), (8, 0, [1e30, 1.0])]


def test_hard_negatives_edges(spark):
    usable = [(0, 0, [1.0, 0.5]), (10, 0, [0.9, 0.5]), (11, 1, [0.8, 0.5]), (12, 1, [0.8, 0.5]), (13, 0, [-1.0, 0.0])]
    rows = [*UNUSABLE, *usable, (11, 1, [0.7, 0.1]), (11, 0, [1.0, 0.5])]  # of vec_id 11 the row with the largest label, then vector
    asks = F.col("vec_id") % 10 == 0
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), "vec_id", "label", "embedding", asks).collect())) == hard_by_loop(usable, lambda i: i % 10 == 0)
    for left in (UNUSABLE, [], usable[:1], usable[2:4]):
        assert hard_negatives.mine(frame(spark, left), "vec_id", "label", "embedding", asks).count() == 0
    lonely = hard_negatives.mine(frame(spark, [(0, 0, [1.0]), (1, 1, [1.0]), (2, 0, [1.0])]), "vec_id", "label", "embedding", asks).collect()
    assert [tuple(r) for r in lonely] == [(0, 2, 1, 1, 65536, 65536)]


def whitened_by_numpy(rows, most=16):
    x = np.array([[math.floor(64 * e) + 1_000_000 for e in v] for _, _, v in rows])
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(0)
    centred = listed - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ v[:, ::-1][:, :most] / np.sqrt(e[::-1][:most]), e[::-1] / e.sum()


@pytest.mark.parametrize("n, dim", [(500, 24), (200, 1)])
def test_whitening(spark, n, dim):
    rows = planted_vectors(n, dim, dim)
    got = whitening.components(frame(spark, rows)).collect()
    size, deviation, want, explained = whitened_by_numpy(rows)
    k = min(dim, 16)
    assert len(got) == n * k
    mine = np.zeros((n, k))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert r.n == size and r.deviation == deviation[r.vec_id] and abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-9
    sign = np.sign((mine * want[:, :k]).sum(0))
    assert np.abs(mine * sign - want[:, :k]).max() < 1e-7


def test_rotations():
    rng = np.random.default_rng(4)
    for r in (rng.normal(size=(7, 7)), rng.normal(size=(3, 6)), np.diag([1e8, 1.0, 1e-6]), np.zeros((2, 2)), np.ones((5, 4))):
        length, v = whitening.rotations(r)
        assert np.allclose(length[: min(r.shape)], np.linalg.svd(r, compute_uv=False), rtol=1e-12, atol=1e-9) and np.allclose(v.T @ v, np.eye(r.shape[1]))


def test_whitening_edges(spark):
    rows = [*UNUSABLE[:4], *UNUSABLE[6:], (20, None, [0.5, 1.0]), (None, 0, [0.25, -1.0]), (21, 0, [0.5, 1.0]), (22, 1, [2.0, 2.0])]
    got = whitening.components(frame(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(i, c) for i in (0, 20, 21, 22) for c in (1, 2)] and got[0].n == 3
    for left in ([], UNUSABLE[:4], [(1, 0, [1.0, 2.0]), (2, 0, [1.0, 2.0])]):
        none = whitening.components(frame(spark, left))
        assert none.count() == 0 and none.columns == whitening.components(frame(spark, rows)).columns
    flat = whitening.components(frame(spark, [(1, 0, [1.0, 5.0]), (2, 0, [2.0, 5.0]), (3, 0, [4.0, 5.0])])).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    far = whitening.components(frame(spark, [(1, 0, [1e13, 5.0]), (2, 0, [2.0, 5.5]), (3, 0, [4.0, 5.0])])).collect()
    assert all(r.deviation is None for r in far) and len(far) == 6
