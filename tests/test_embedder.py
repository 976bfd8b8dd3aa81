"""The learned embedder against NumPy's decomposition of the whole matrix, and against word hashing by what neighbours share."""

import math

import numpy as np
import pyarrow.parquet as pq

from corvine.functions.protocols import HashedEmbedder
from corvine.operators import sparse
from corvine.plans.embedder import LearnedEmbedder

DATA = "/root/testdata/sf0.001"


def test_against_numpy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tokens = {r.doc_id: set(r.tokens) for r in sparse.tokenised(docs).collect()}
    n, df = len(tokens), {}
    for t in (t for d in tokens.values() for t in d):
        df[t] = df.get(t, 0) + 1
    raw = {t: math.log(max(0.5, n - f + 0.5)) - math.log(max(0.5, f + 0.5)) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    column = {t: i for i, t in enumerate(sorted(t for t, f in df.items() if f >= 2))}
    a = np.zeros((n, len(column)))
    ids = sorted(tokens)
    for r, d in enumerate(ids):
        for t in tokens[d] & column.keys():
            a[r, column[t]] = 0.25 * mean if raw[t] < 0 else raw[t]
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    model = LearnedEmbedder.fit(docs, 8)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.singular[:6], s[:6], rtol=1e-2) and model.dimension == 8
    got = {r.doc_id: np.array(r.embedding) for r in model.embed(docs).collect()}
    assert len(got) == n and all(abs(np.linalg.norm(v) - 1) < 1e-5 for d, v in got.items() if a[ids.index(d)].any())

    # Nearest neighbours share a document's language more often than by hashed words.
    lang = dict(zip(*(pq.read_table(f"{DATA}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "lang")), strict=True))
    text = dict(zip(*(pq.read_table(f"{DATA}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")), strict=True))
    hashed = HashedEmbedder(8).embed([text[d] for d in ids])

    def agreeing(x):
        near = x @ x.T - 2 * np.eye(len(x))
        return np.mean([lang[ids[i]] == lang[ids[j]] for i, j in enumerate(near.argmax(1))])

    assert agreeing(np.array([got[d] for d in ids])) > agreeing(hashed)


def test_few_documents(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red stone"), (3, None), (4, "apple stone red"), (None, "red")], "doc_id long, text string")
    model = LearnedEmbedder.fit(docs, 4)
    got = {r.doc_id: r.embedding for r in model.embed(docs).collect()}
    assert set(got) == {1, 2, 3, 4} and not any(got[3]) and model.dimension <= 3
    assert LearnedEmbedder.fit(docs.limit(0), 4).embed(docs).count() == 4
