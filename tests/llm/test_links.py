"""Every link of the similarity join, against a loop over all pairs."""

import random
import re

from corvine.llm import near_dedup

words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_every_link(spark, sample, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = [(r["doc_id"], r["text"]) for r in sample]
    for i in range(90):
        w = base[:]
        for _ in range(rng.randrange(8)):
            w[rng.randrange(200)] = f"x{i}_{rng.randrange(50)}"
        rows.append((10_000 + i, " ".join(w)))
    rows += [(20_000 + i, rows[-1 - i][1].upper()) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent, part in ((3, 90, 1000), (5, 80, 7)):
        monkeypatch.setattr(near_dedup, "PART", part)
        sets = {i: frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if (w := words(t)) else frozenset() for i, t in rows}
        want = {i: sum(bool(i != j and s and 100 * len(s & o) >= percent * len(s | o)) for j, o in sets.items()) for i, s in sets.items()}
        got = near_dedup.linked_documents(docs, k, percent).collect()
        assert {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 5
        old = {r.doc_id: (r.n_shingles, r.component_id, r.class_id) for r in near_dedup.link_components(docs, k, percent).collect()}
        assert {r.doc_id: (r.n_shingles, r.component_id, r.class_id) for r in got} == old
