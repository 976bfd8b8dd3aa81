"""The batch search asks every 50th row, in blocks, and ranks ties by key."""

import numpy as np
import pyarrow.parquet as pq

from corvine import queries
from corvine.operators import dense

DATA = "/root/testdata/sf0.001"


def test_every_50th_row_asks(spark):
    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pydict()
    ids, x = np.array(rows["vec_id"]), np.array(rows["embedding"], dtype=np.float64)
    want = {}
    for q in ids[ids % 50 == 0]:
        d2 = np.round(((x - x[ids == q][0]) ** 2).sum(1), 9)
        want[q] = ids[np.lexsort((ids, d2))[:5]].tolist()
    got = {}
    for r in sorted(queries.QUERIES["knn_batch"](spark, DATA).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.vec_id)
    assert got == want and len(got) == len(ids[ids % 50 == 0])


def test_blocks_and_ties(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0 / 3]) for i in range(30)], "vec_id long, embedding array<float>").repartition(4)
    whole, blocks = (sorted(map(tuple, dense.nearest_to_all(vectors, vectors.where("vec_id % 2 = 0"), 4, block=n).collect())) for n in (100, 4))
    assert whole == blocks and {r[0] for r in whole} == set(range(0, 30, 2))
    assert [r[1] for r in sorted((r for r in whole if r[0] == 28), key=lambda r: r[3])] == [1, 4, 7, 10]
    assert dense.nearest_to_all(vectors, vectors.limit(0), 4).count() == 0
