"""Searches that skip blocks give the rows of scoring everything, for many queries at once."""

import math
import random

from corvine.operators import sparse
from corvine.plans.blocks import BlockIndex


def by_scoring_all(docs, queries, k):
    """docs: id to set of terms; queries: id to set of terms."""
    n, df = len(docs), {}
    for terms in docs.values():
        for t in terms:
            df[t] = df.get(t, 0) + 1
    avgdl = sum(map(len, docs.values())) / n
    raw = {t: math.log(max(0.5, n - f + 0.5)) - math.log(max(0.5, f + 0.5)) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    out = set()
    for q, asked in queries.items():
        scores = {}
        for d, terms in docs.items():
            if shared := asked & terms:
                w = 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(terms) / avgdl))
                scores[d] = round(sum(idf[t] for t in shared) * w, 6)
        best = sorted((-s, d) for d, s in scores.items() if s > 0)[:k]
        out |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(best)}
    return out


def compared(spark, docs, queries, k, band):
    index = BlockIndex.build(spark.createDataFrame([(d, " ".join(sorted(t))) for d, t in docs.items()], "doc_id long, text string").repartition(3), band=band)
    hits, report = index.best(spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "qid long, term string"), k)
    got = {tuple(r) for r in hits.collect()}
    want = by_scoring_all({d: t for d, t in docs.items()}, queries, k)
    assert {r[:2] + r[3:] for r in got} == {r[:2] + r[3:] for r in want}
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(got), sorted(want), strict=True))
    return {r.qid: r for r in report.collect()}


def test_rare_and_common(spark):
    """Terms from rare to very common, texts of many lengths, queries of any mixture; unknown terms and queries without a hit."""
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(400)]
    docs = {d: {t for t in vocabulary if rng.random() < min(0.9, 2 / (int(t[1:]) + 1)) * rng.choice([0.2, 1, 1])} | {f"u{d % 37}"} for d in range(600)}
    queries = {q: set(rng.sample(vocabulary, rng.randrange(1, 6))) | ({"t0", "t1"} if q % 2 else set()) | ({f"u{q}"} if q % 3 else set()) for q in range(20)}
    queries |= {90: {"t0"}, 91: {"nosuch"}, 92: {"t0", "t1", "t2", "nosuch"}, 93: set(vocabulary), 94: {"u1", "t0"}}
    report = compared(spark, docs, queries, 10, 8)
    assert report[94].skipped > 0.5 and 91 not in report


def test_negative_idf(spark):
    """Where nearly all terms are in most documents the floor itself is negative, and no score is above 0 or few are."""
    docs = {d: {"a", "b", "c"} | ({"d"} if d % 2 else set()) | ({"rare"} if d < 5 else set()) | {f"x{d % 2}", f"y{d % 3}"} for d in range(60)}
    queries = {0: {"a", "b"}, 1: {"rare", "a", "b", "c"}, 2: {"x0", "a"}, 3: {"y1", "rare", "d"}, 4: {"rare", "d", "a", "y2"}}
    compared(spark, docs, queries, 3, 4)


def test_one_search(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple tree"), (3, None), (4, ""), (5, "red tree"), (6, "stone"), (7, "RED")], "doc_id long, text string")
    index = BlockIndex.build(docs)
    want = sparse.top(sparse.scores(sparse.tokenised(docs), ["red", "apple"]), 3)
    assert [tuple(r) for r in index.search(["red", "apple", "red"], 3).collect()] == [tuple(r) for r in want.collect()]
    assert index.search([], 3).count() == 0 and index.search(["none"], 3).count() == 0
    assert BlockIndex.build(docs.limit(0)).search(["red"], 3).count() == 0


def test_few_documents(spark):
    docs = {d: {"w", f"v{d % 3}"} for d in range(12)} | {20: set(), 21: {"lone"}, 22: {"lone"}}
    compared(spark, docs, {0: {"v1"}, 1: {"lone", "v0"}, 2: {"w", "lone"}}, 50, 2)
