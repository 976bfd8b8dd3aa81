"""Searches in cells: the exact one gives the rows of comparing all, the other most of them."""

import numpy as np
import pytest

from corvine.plans import cells
from corvine.plans.cells import CellIndex


def compared(rows, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = set()
    for q in asked:
        d2 = np.round(((x - x[ids == q][0]) ** 2).sum(1), 9)
        order = np.lexsort((ids, d2))[:k]
        out |= {(q, int(ids[i]), n + 1) for n, i in enumerate(order)}
    return out


@pytest.mark.parametrize("lot, salted, block, k", [(16, 2, 7, 12)])
def test_clusters_and_copies(spark, monkeypatch, lot, salted, block, k):
    """A third of all rows are copies of one vector, the rest lie in clusters; small lots and blocks make the hot cell many."""
    for name, value in (("LOT", lot), ("SALTED", salted), ("BLOCK", block)):
        monkeypatch.setattr(cells, name, value)
    rng = np.random.default_rng(k)
    centres, hot = rng.normal(size=(9, 6)), [1.0] * 6
    rows = [(i, hot if i % 3 == 0 else [float(e) for e in np.float32(centres[i % 9] + 0.2 * rng.normal(size=6))]) for i in range(500)]
    asked = [i for i, _ in rows if i % 20 == 0]
    frame = spark.createDataFrame([*rows, (None, hot), (900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6)], "vec_id long, embedding array<float>").repartition(4)
    index, queries = CellIndex.build(frame), frame.where("vec_id % 20 = 0")
    want = compared(rows, asked, k)
    exact = index.nearest_exact(queries, k).collect()
    assert {(r.qid, r.vec_id, r["rank"]) for r in exact} == want and len(exact) == len(want)
    distances = {(r.qid, r["rank"]): r.d2 for r in exact}
    near = index.nearest(queries, k).collect()
    assert len(near) == len(want) and sum(r.d2 <= distances[r.qid, k] for r in near) >= 0.9 * len(want)


def test_few_rows(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "vec_id long, embedding array<float>")
    index = CellIndex.build(frame)
    for search in (index.nearest_exact, lambda q, k: index.nearest(q, k, probes=9)):
        assert sorted((r.qid, r.vec_id, r.d2, r["rank"]) for r in search(frame.where("vec_id > 1"), 5).collect()) == [(2, 1, 0.0, 1), (2, 2, 0.0, 2), (2, 3, 25.0, 3), (3, 1, 25.0, 2), (3, 2, 25.0, 3), (3, 3, 0.0, 1)]
    assert index.nearest_exact(frame.limit(0), 5).count() == 0
    nothing = CellIndex.build(frame.limit(0))
    assert nothing.nearest_exact(frame, 5).count() == 0 and nothing.nearest(frame, 5).count() == 0
