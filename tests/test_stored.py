"""Intervals, stored blocks and snapshots against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corvine.operators import chunking, intervals
from corvine.plans import snapshots
from corvine.plans.snapshots import Snapshot, changes, differing
from corvine.plans.text_blocks import TextBlocks


@pytest.mark.parametrize("span", [7, 1 << 16])
def test_stabbed(spark, span):
    rng = random.Random(span)
    rows = [(g, s, s + rng.choice([0, 1, 3, 20, 90]), o, f"n{o}", "x") for g in "ab" for o, s in enumerate(rng.randrange(-20, 100) for _ in range(60))]
    rows += [(None, 1, 50, 1, "n", "x"), ("a", None, 5, 99, "n", "x")]
    asked = [(g, p) for g in "abc" for p in range(-25, 130)] + [("a", 5), (None, 5), ("a", None)]
    got = intervals.stabbed(spark.createDataFrame(rows, "g string, start long, end long, ordinal int, name string, kind string").repartition(3), spark.createDataFrame(asked, "g string, at long").repartition(3), "g", "name", "kind", span=span)
    want = []
    for g, p in asked:
        if g is None or p is None:
            continue
        over = [r for r in rows if r[0] == g and r[1] is not None and r[1] <= p < r[2]]
        best = min(over, key=lambda r: (r[2] - r[1], -r[3]), default=None)
        want.append((g, p, best[3], best[4], "x") if best else (g, p, None, None, None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_one_long_file(spark):
    """A million lines under nested scopes: as many pieces as there are bins, and no row for each covered line."""
    n = 1_000_000
    scopes = spark.createDataFrame([("f", "outer", "class", 1, n, 0), ("f", "inner", "method", 10, n - 10, 1), ("f", "leaf", "function", 500_000, 500_001, 2)], "path string, name string, kind string, start_line int, end_line int, ordinal int")
    lines = chunking.deepest_scopes(scopes, spark.createDataFrame([("f", n)], "path string, n_lines int"))
    assert {(r.name, r["count"]) for r in lines.groupBy("name").count().collect()} == {("outer", 19), ("inner", n - 21), ("leaf", 2)}


def test_elements(spark):
    html = "<DIV><ul><li><a href=1></a><li><a></a></ul></div><p></div><a><ul><a>"
    tagged = intervals.tags(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string"), "page_id", "html", "div", "ul", "li")
    got = {(r.name, r.start): r.end for r in intervals.elements(tagged, "page_id").collect()}
    assert got == {("div", 0): html.index("</div>"), ("ul", 5): html.index("</ul>"), ("li", 9): len(html), ("li", html.index("<li>", 10)): len(html), ("ul", html.rindex("<ul>")): len(html)}


@pytest.mark.parametrize("size", [5, 4096])
def test_text_blocks(spark, size):
    rng = random.Random(size)
    texts = [(1, "aé" * 9), (2, ""), (3, None), (4, "x" * 5), (5, "y" * 10_001), (None, "zz")]
    blocks = TextBlocks.build(spark.createDataFrame(texts, "doc_id long, text string"), size=size)
    raw = {k: (t or "").encode() for k, t in texts}
    asked = [(i, rng.choice([1, 2, 3, 4, 5, 5, 77]), *sorted((rng.randrange(-5, 40), rng.randrange(-5, 40) * rng.choice([1, 300])))) for i in range(60)] + [(60, 5, 3, 3), (61, 4, 9, 2)]
    got = {r.id: (r.key, bytes(r.bytes)) for r in blocks.splice(spark.createDataFrame(asked, "id long, key long, start long, end long")).collect()}
    assert got == {i: (k, raw.get(k, b"")[max(s, 0) : max(e, 0)]) for i, k, s, e in asked}
    few = spark.createDataFrame([(0, 5, 4, 5)], "id long, key long, start long, end long")
    assert blocks.blocks(blocks.needed(few)).select("key").distinct().count() == 1


def test_snapshots(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "SPAN", 4)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string, n int")
    rows = {i: (i, f"t{i}", i % 3) for i in range(-40, 900)}
    new = dict(rows)
    del new[100], new[101]
    new |= {200: (200, None, 2), 201: (201, "t201", None), 5000: (5000, "added", 1), -3: (-3, "t-3", 0)}
    a, b = Snapshot.build(frame([*rows.values(), (None, "no key", 1)]).repartition(3), "id"), Snapshot.build(frame([*new.values()]).repartition(5), "id")
    found, report = changes(a, b)
    want = {(i, "removed" if i not in new else "added" if i not in rows else "changed") for i in {*rows, *new} if rows.get(i) != new.get(i)}
    assert {tuple(r) for r in found.collect()} == want and (100, "removed") in want
    assert report["bytes_read"] < report["bytes_all"] / 10
    assert {r.leaf for r in differing(a, b).collect()} == {i // 4 for i, _ in want}
    monkeypatch.setattr(snapshots, "PUSHED", 0)
    assert {tuple(r) for r in changes(a, b)[0].collect()} == want
    same, report = changes(a, Snapshot.build(frame([*rows.values()]), "id"))
    assert same.count() == 0 and report["bytes_read"] == 0
    # null isn't the empty string, nor do columns trade what they hold
    x, y = frame([(1, None, 1), (2, "", 2)]), frame([(1, "", 1), (2, None, 2)])
    assert changes(Snapshot.build(x, "id"), Snapshot.build(y, "id", place=F.floor(F.col("id") / 4)))[0].count() == 2
