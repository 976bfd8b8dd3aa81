import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvine.functions import text as T
from corvine.operators import dense, fusion, graph, sparse, symbols, versions
from corvine.queries import source_files


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [
        ("parseHttpRequest", ["parsehttprequest", "parse", "http", "request"]),
        ("HTTPServer", ["httpserver", "http", "server"]),
        ("getHTTPs", ["gethttps", "get", "htt", "ps"]),
        ("snake_case snake", ["snake", "case"]),
        ("", []),
        ("été Simple simple", ["t", "simple"]),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, T.tokens(F.col("t")), t=text) == expected


def test_idf_floor_and_scores(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["a"]), (4, [])], "doc_id long, tokens array<string>").withColumn("doc_len", F.size("tokens").cast("long"))
    stats, df = sparse.corpus_stats(docs), sparse.document_frequency(docs)
    idf = {r.term: r.idf for r in sparse.idf(df, stats).collect()}
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in (("a", 3), ("b", 1), ("c", 1))}
    mean = sum(raw.values()) / 3
    assert idf["a"] == pytest.approx(0.25 * mean) and idf["b"] == pytest.approx(raw["b"])
    got = {r.doc_id: r.score for r in sparse.scores(docs, ["b", "unseen", "b"]).collect()}
    assert got == {1: pytest.approx(raw["b"] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.25)))}
    gone = spark.createDataFrame([(1,), (1,)], "doc_id long")
    assert sparse.corpus_stats(sparse.without(docs, gone)).first().n_docs == 3


def test_nearest(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.d2) for r in dense.nearest(vectors, [1.0, 0.0], 10).collect()] == [(0, 0.0), (1, 2.0), (2, 2.0)]
    batch = dense.nearest_to_each(vectors, [(7, [0.0, 1.0])], 2).orderBy("rank").collect()
    assert [(r.qid, r.vec_id) for r in batch] == [(7, 1), (7, 2)]


def test_fusion(spark):
    d = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, rank int")
    s = spark.createDataFrame([(3, 0), (2, 1)], "doc_id long, rank int")
    assert [r.doc_id for r in fusion.fused(d, s, 3).collect()] == [2, 1, 3]


@settings(max_examples=15, deadline=None)
@given(st.binary(max_size=60), st.integers(-5, 70), st.integers(-5, 70))
def test_splice(spark, raw, a, b):
    x, y = min(max(a, 0), len(raw)), min(max(b, 0), len(raw))
    got = spark.createDataFrame([(raw,)], "c binary").select(T.spliced(F.col("c"), F.lit(a), F.lit(b)).alias("x")).first().x
    assert got == raw[x:y].decode("utf-8", "replace")


def test_python_symbols():
    text = 'class A(B):\n    """Doc."""\n    def go(self, x: int, *rest):\n        return run(x).stop()\n\nasync def main(a, b=1):\n    """First.\n    Second."""\n    await A().go(a)\n'
    a, go, main = symbols.PythonSymbols().extract("a.py", text)
    assert (a["name"], a["kind"], a["start_line"], a["end_line"], a["docstring"]) == ("A", "class", 1, 4, "Doc.")
    assert (go["owner"], go["args"], go["calls"]) == ("A", "x: int", ["run", "stop"])
    assert (main["is_async"], main["args"], main["calls"]) == (True, "a, b", ["A", "go"])


def test_braced_symbols():
    text = "// class Fake {\nexport class View extends Base {\n  render(props) {\n    const s = 'a { b';\n    return draw(s);\n  }\n}\n\nexport const add = async (a, b) => {\n  return a + b;\n};\n\nfn main() {\n}\nfunc (s *T) Run(x int) error {\n}\nint sum(int a, int b) {\n  if (a) { return b; }\n}\n"
    got = [(s["kind"], s["owner"], s["name"], s["start_line"], s["end_line"], s["args"], s["is_async"]) for s in symbols.BracedSymbols().extract("x.ts", text)]
    assert got == [
        ("class", "", "View", 2, 7, "", False), ("method", "View", "render", 3, 6, "props", False), ("function", "", "add", 9, 11, "a, b", True),
        ("function", "", "main", 13, 14, "", False), ("function", "", "Run", 15, 16, "x int", False), ("function", "", "sum", 17, 19, "int a, int b", False),
    ]


def test_ruby_symbols():
    text = "module M\n  class A\n    def go(x)\n      if x\n        run\n      end\n    end\n  end\nend\n\ndef top\n  [1].each do |y|\n  end\nend\n"
    got = [(s["kind"], s["owner"], s["name"], s["start_line"], s["end_line"]) for s in symbols.RubySymbols().extract("a.rb", text)]
    assert got == [("class", "", "M", 1, 9), ("class", "", "A", 2, 8), ("method", "A", "go", 3, 7), ("function", "", "top", 11, 14)]


def test_broken_source_has_no_symbols(spark):
    files = spark.createDataFrame([("x.py", ".py", b"def (:"), ("y.md", ".md", b"# hi")], "path string, ext string, content binary")
    found = symbols.symbols(files)
    assert found.count() == 0
    assert {r.summary for r in symbols.summaries(files, found).collect()} == {symbols.NO_SYMBOLS}


def test_links_are_mutual(spark):
    files = source_files(spark)
    near = graph.neighbours(files, graph.edges(files, graph.imports(files))).collect()
    out = {(r.path, x) for r in near for x in r.imports}
    back = {(x, r.path) for r in near for x in r.imported_by}
    assert out == back and ("pkg/core.py", "pkg/util.py") in out


def test_debounce(spark):
    rows = [("k", t) for t in ("2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:00:03")]
    events = spark.createDataFrame(rows, "k string, t string").withColumn("ts", F.to_timestamp("t"))
    assert [(r.batch, r.n) for r in versions.debounced(events, "k", "ts", 2).orderBy("batch").collect()] == [(0, 2), (1, 2)]


def test_debounce_carries_over_batches(spark):
    """A hot key's batches are found over many Arrow batches, as by a loop."""
    import random

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(100_000)) for _ in range(5_000)] + [("k1", None)]
    events = spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.k, r.batch): (r.batch_start_us, r.n) for r in versions.debounced(events, "k", "ts", 300).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for key in {k for k, _ in rows}:
        start, number, n = None, -1, 0
        for t in sorted(s for k, s in rows if k == key and s is not None):
            if start is None or t >= start + 300:
                start, number, n = t, number + 1, 0
            n += 1
            want[key, number] = (start * 1_000_000, n)
    assert got == want


def test_lines_of_bytes(spark):
    from corvine.operators import chunking

    rows = [(1, b"a\nbc\n\n"), (2, None), (3, b""), (4, b"\xff\n\xc3\xa9\r\n"), (5, b"\n"), (6, b"no end")]
    got = {}
    for r in chunking.line_ranges(spark.createDataFrame(rows, "doc_id long, text binary").repartition(2), with_text=True).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append(((r.line, r.byte_start, r.byte_end), bytes(r.line_bytes)))
    for i, raw in rows:
        raw, at = raw or b"", 0
        for (n, a, b), line in zip([x for x, _ in got[i]], raw.split(b"\n"), strict=True):
            assert a == at and raw[a:b] == line and n >= 1
            at = b + 1
        assert [x for _, x in got[i]] == raw.split(b"\n")
    plan = chunking.line_ranges(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize(
    "ext, text, expected",
    [
        (".go", 'package x\nimport "fmt"\nimport (\n a "b/c"\n _ "d" // e\n)\nfunc f() { g("no") }', ["fmt", "b/c", "d"]),
        (".rs", "use a::{b, c::d as e, f::*};\npub use crate::x;\nmod y;\nmod z { }\n// use no;\nfn m() { let s = \"use no;\"; }", ["a.b", "a.c.d", "a.f", "crate.x", "y"]),
        (".ts", "import { a,\n b } from './t';\nexport * from './q'\nconst m = await import('./dyn');\nimport './side'\nconst r = require(\"r\")\n/* import x from 'no' */", ["./t", "./q", "./dyn", "./side", "r"]),
        (".java", 'package p;\nimport static a.B.c;\nimport java.util.*;\nclass X { String s = "import no;"; }', ["a.B.c", "java.util"]),
        (".c", '#include "list.h"\n #  include <stdio.h>\n/* #include "no.h" */\n#define X "y"', ["list.h", "stdio.h"]),
        (".rb", "require_relative 'model'\nrequire('x')\n# require 'no'", ["model", "x"]),
        (".py", "import a.b, c\nfrom . import d\nfrom e import (\n f)\nimport c\n", ["a.b", "c", "e"]),
        (".py", "import a\ndef (:\nfrom b import c\n", ["a", "b"]),
    ],
)
def test_imports(ext, text, expected):
    from corvine.operators.imports import imported

    assert imported(ext, text)[1] == expected
