"""Chunk deduplication leaves nothing of exact copies, and chance repeats of short ends alone."""

import random

from corvine.llm import chunk_dedup


def rows_with_copies():
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}é"[: rng.randrange(3, 8)] for _ in range(n))
    texts = [prose(n) for n in (1, 2, 3, 5, 8, 12, 14, 15, 16, 17, 18, 20, 40, 77, 150, 400) for _ in range(4)]
    texts = list(dict.fromkeys(texts))
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts)]
    return rows + [(2000, "x"), (2001, "x"), (2002, None), (2003, ""), (2004, prose(60) + " Thank you."), (2005, prose(60) + " Thank you."), (2006, "Thank you.")]


def test_copies_go_completely(spark):
    rows = rows_with_copies()
    got = {r.doc_id: r for r in chunk_dedup.chunk_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        r, n = got[i], len((t or "").encode())
        if 1000 <= i < 2000 or i == 2001:
            assert (r.n_removed, r.n_duplicate, r.kept) == (n, r.n_chunks, b"") and n
        else:
            assert (r.n_removed, r.kept) == (0, (t or "").encode())
