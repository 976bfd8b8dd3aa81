"""The texts that leave the pipeline hold the words that the mix takes."""

import re

import corpus_pipeline
from corvine.llm import mixing
from pyspark.sql import functions as F


def test_texts_are_what_is_taken(spark, tmp_path):
    rows = [(i, f" \t{'é' * (i % 3)}a{i}\n\n" + "b  c\td\n" * (i % 11), "en", "abcd"[i % 4 if i % 5 else 0], 7) for i in range(300)] + [(None, "no number", "en", None, 9), (999, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    mixed = mixing.mix(mixing.with_quality(docs, labels)).collect()
    want = {r.doc_id: r.taken for r in mixed if r.taken}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    texts, got, cuts = {r[0]: r[1] for r in rows}, {}, 0
    for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
        assert words(r.text) == words(texts[r.doc_id])[: r.taken] and r.taken == len(words(r.text)) <= r["size"]
        assert r.text == texts[r.doc_id] or r.n_chars == len(r.text)
        cuts += r.taken < r["size"]
    assert got == want and cuts and any(r.taken > r["size"] for r in mixed)
