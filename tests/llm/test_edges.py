"""Null, empty, long, repeated and clashing rows, and empty tables, through all operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvine.llm import chunk_dedup, decontaminate, exact_dedup, language_id, line_dedup, mixing, near_dedup, ngram_lm, quality_crf, suffix_dedup

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (None, "wordé wordé"), (3, "..."), (1, "one two")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 0), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")


def test_exact(edge, nothing):
    got = exact_dedup.exact_duplicates(edge).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert (by[1].keep_id, by[1].group_size, by[1].kept) == (4, 3, False)
    assert (by[2].keep_id, by[2].group_size, by[2].text_sha256) == (3, 2, sha(""))
    assert by[None].kept and by[6].n_blocks == 59
    assert sum(r.kept for r in got if r.doc_id == 4) == 2
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def test_near(edge, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_components(edge).collect()}
    assert len(got) == 8
    assert got[1] == got[4] == (3, 1)
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[5] == (0, 5) and got[6] == (1, 6) and got[7] == (1, 7)
    assert near_dedup.link_components(nothing).count() == 0
    kept = near_dedup.keep_one(edge)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7] and kept.columns == edge.columns


def test_suffix_and_chunks(edge, nothing):
    for find in (suffix_dedup.suffix_dedup, chunk_dedup.chunk_dedup):
        got = {r.doc_id: r for r in find(edge).collect()}
        assert len(got) == 8 and got[2].n_bytes == 0 and got[4].n_removed == 0 and got[None].kept == b"no number at all"
        assert find(nothing).count() == 0
    assert got[6].n_removed > 200_000  # one chunk over and over, within the document


def test_mix(edge, nothing, labels):
    got = mixing.mix(mixing.with_quality(edge, labels)).collect()
    assert len(got) == 9
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target)
    assert mixing.mix(mixing.with_quality(nothing, labels)).count() == 0


def test_lines(edge, nothing):
    kept = line_dedup.deduplicated(edge)
    assert kept.columns == edge.columns and kept.count() == 8
    assert {r.doc_id: r.text for r in kept.collect()}[2] is None
    assert line_dedup.line_dedup(nothing).count() == 0 and line_dedup.line_dedup(edge).where("n_removed > 0").count() == 0


def test_decontaminate(edge, nothing, benchmark):
    rows = decontaminate.contamination(edge, benchmark).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and (got[7].n_words, got[7].n_hit, got[7].items) == (2, 2, ["1"])
    assert got[6].items == ["null"] and got[6].n_hit == 40_000 and got[2].n_words == 0
    clean = decontaminate.drop_contaminated(edge, benchmark)
    assert clean.columns == edge.columns and clean.count() == 7
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert decontaminate.contamination(edge, benchmark.limit(0)).count() == 0 or all(r.n_hit == 0 for r in decontaminate.contamination(edge, benchmark.limit(0)).collect())


def test_language(edge, nothing):
    model = language_id.LanguageModel.fit(edge)
    got = {r.doc_id: r for r in language_id.identify(edge, model).collect()}
    assert (got[2].lang_pred, got[3].lang_pred, got[5].lang_pred) == ("und",) * 3 and got[6].lang_pred == "fr" and got[1].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    void = language_id.LanguageModel.fit(nothing)
    assert {r.lang_pred for r in language_id.identify(edge, void).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0 and language_id.keep_identified(edge, model).columns == edge.columns


def test_quality(edge, nothing, labels):
    model = quality_crf.fit(edge, labels)
    got = quality_crf.score(edge, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    lone = quality_crf.fit(edge, labels.limit(0))
    assert {r.score for r in quality_crf.score(edge, lone).collect()} == {1.0}
    assert quality_crf.score(nothing, model).count() == 0


def test_language_model(edge, nothing):
    model = ngram_lm.NgramModel.fit(edge)
    got = {r.doc_id: r for r in ngram_lm.score(edge, model).collect()}
    assert got[2].n_tokens == got[5].n_tokens == 1 and got[6].n_tokens == 40_001 and model.tokens == sum(r.n_tokens for r in ngram_lm.score(edge, model).collect())
    void = ngram_lm.NgramModel.fit(nothing)
    assert all(r.n_known == 0 for r in ngram_lm.score(edge, void).collect())
    assert ngram_lm.score(nothing, model).count() == 0


def test_stages(spark, edge, tmp_path, benchmark, labels):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, str(tmp_path))
        assert name == "mix" or sorted(out.columns) == sorted(edge.columns)
        out.withColumns({c: F.col(c) for c in out.columns}).count()
