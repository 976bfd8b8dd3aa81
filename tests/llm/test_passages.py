"""Repeated passages on one or two lines, and whole copies of short documents, against a plain loop."""

import re

from corvine.llm import line_dedup

BLANK = b" \t\n\x0b\x0c\r"
LEAST = line_dedup.LEAST_WORDS
lines_of = lambda t: [x.strip(BLANK) for x in re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(b"\n") if x.strip(BLANK)]
long_line = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))

PLANTED = [
    (1, f"own one\n{long_line('a')}\nrest one"),
    (2, f"own two\n\n  {long_line('a').upper()}  \nrest two\n"),
    (3, f"{long_line('b', 30)}\n{long_line('c', 25)}\nlast three"),
    (4, f"first four\n{long_line('b', 30)}\n\n{long_line('c', 25)}"),
    (5, f"first five\n{long_line('b', 30)}\nother five"),
    (6, "a short one"),
    (7, "A short one\n"),
    (8, "a short one\nand more\nand more than that"),
    (9, "two lines\nof text"),
    (10, "two lines\n\nof text"),
    (11, f"{long_line('d')}\nbetween\n{long_line('d')}"),
    (12, long_line("e", 50)),
    (13, f"x\n{long_line('e', 50)}"),
    (14, long_line("f", 49)),
    (15, f"x\n{long_line('f', 49)}"),
    (16, None),
    (17, ""),
]


def expected(rows):
    """Of each document, the numbers of its lines that go: each unit's first holder by doc_id, then place, keeps it."""
    seen, gone = set(), {}
    for i, t in sorted(rows):
        q, gone[i] = lines_of(t), set()
        for x in range(len(q)):
            for k in (1, 2, 3):
                part = tuple(q[x : x + k])
                whole = k == len(q) < 3
                if len(part) < k or not (k == 3 or whole or sum(len(y.split()) for y in part) >= LEAST):
                    continue
                unit = (part, whole and sum(len(y.split()) for y in part) < LEAST)
                if unit in seen:
                    gone[i] |= set(range(x, x + k))
                seen.add(unit)
    return gone


def test_passages(spark, sample):
    for rows in (PLANTED, [(r["doc_id"], r["text"]) for r in sample]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        gone, texts, got = expected(rows), dict(rows), line_dedup.line_dedup(docs, LEAST).collect()
        assert len(got) == len(rows) and any(gone.values())
        for r in got:
            q = lines_of(texts[r.doc_id])
            assert (r.n_lines, r.n_removed) == (len(q), len(gone[r.doc_id]))
            assert lines_of(r.kept) == [x for j, x in enumerate(q) if j not in gone[r.doc_id]]
    assert {i for i, g in expected(PLANTED).items() if g} == {2, 4, 7, 10, 11, 13}


def test_pipeline_cuts_passages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(PLANTED, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert kept[2].split() == "own two rest two".split() and kept[7].strip() == "" and kept[16] is None
