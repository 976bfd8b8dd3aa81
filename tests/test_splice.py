"""Byte ranges of all documents against slices of Python's bytes."""

import hashlib

import pyarrow.parquet as pq
import pytest

from corvine import queries

DATA = "/root/testdata/sf0.001"
CUT = [(1, "é" * 49 + "x" + "é" * 200), (2, "x" + "é" * 200), (3, "x" * 99 + "漢字" * 90), (4, "x" * 98 + "𝄞" * 60), (5, None), (6, ""), (7, "short é"), (8, "é" * 50), (9, "y" * 299 + "é"), (10, "plain " * 80)]


@pytest.mark.parametrize("planted", [True, False])
def test_all_documents(spark, tmp_path, planted):
    where = DATA
    if planted:
        where = str(tmp_path)
        spark.createDataFrame(CUT, "doc_id long, text string").write.parquet(f"{where}/documents.parquet")
    rows = CUT if planted else [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()]
    want = sorted((i, hashlib.md5((t or "").encode()[100:300].decode("utf-8", "replace").encode()).hexdigest()) for i, t in rows)
    got = sorted(map(tuple, queries.QUERIES["splice_bytes_all"](spark, where).collect()))
    assert got == want
    assert any(len((t or "").encode()) != len(t or "") for _, t in rows)
