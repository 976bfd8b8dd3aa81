"""What the language model says of single words is exact: long words made to collide, and very many different words."""

import math
import re
import zlib
from collections import Counter

import pytest

from corvine.llm import ngram_lm


def compared(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", t), "\n"] for t in texts]
    c = Counter(w for i, t in enumerate(tokens) if not held(i) for w in t)
    n, room = c.total(), c.total() + 0.5 * (len(c) + 1)
    got = ngram_lm.op6_ngram_lm(spark, str(folder)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / room) for w in t), rel=1e-11)


def test_thue_morse_words(spark, tmp_path):
    """Words that collide in any polynomial modulo 2**64."""
    word = lambda n, a, b: "".join((a, b)[i.bit_count() & 1] for i in range(n))
    pairs = [(n, *p) for n in (64, 512, 1024, 2048) for p in ("ab", "ba", "cd", "dc")]
    compared(spark, tmp_path, [f"{word(*p)} q" for p in pairs for _ in range(2)])


def test_many_words_in_few_contexts(spark, tmp_path):
    """30,000 different words after each of 20 others: more than 32 bits tell apart."""
    compared(spark, tmp_path, [" ".join(f"c{j} u{i}x{j}" for j in range(20)) for i in range(30_000)])
