"""Many whole documents as queries: products of lots and blocks give the rows of scoring everything."""

import random

import pytest
from test_blocks import by_scoring_all

from corvine.functions import text as T
from corvine.plans.blocks import BlockIndex


@pytest.mark.parametrize(("k", "band"), [(3, 4), (700, 64)])
def test_best_of_all(spark, k, band):
    rng = random.Random(k)
    docs = {d: {f"t{i}" for i in range(200) if rng.random() < 3 / (i + 2)} | {f"u{d % 37}"} for d in range(600)} | {601: set()}
    queries = {q: docs[q] for q in range(0, 600, 20)} | {900: {"nosuch"}, 901: {"t0", "nosuch"}}
    index = BlockIndex.build(spark.createDataFrame([(d, " ".join(sorted(t))) for d, t in docs.items()], "doc_id long, text string").repartition(3), band=band)
    asked = spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "qid long, term string")
    got, want = sorted(map(tuple, index.best_of_all(asked, k).collect())), sorted(by_scoring_all(docs, queries, k))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert index.best_of_all(asked.limit(0), k).count() == 0


def test_token_set(spark):
    texts = ["HTTPServer getHTTPResponse x2Y ABC aB Ab é1É_under CamelCase a", "", "İstanbul K MLOps2Go", "123ABCdef\nnextLine"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.tokens("text").alias("tokens")).collect()
    assert all({t.encode() for t in r.tokens} == T.token_set(r.text.encode()) for r in rows)
