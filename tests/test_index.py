import os

import pytest

from corvine.functions.protocols import BpeTokenizer
from corvine.plans import index as plans
from corvine.plans import retrieve
from corvine.plans.index import Index
from corvine.schemas import FILES
from corvine.sources.tree import is_source, project_root, read_tree, walk
from corvine.streaming.live import watch

WORDS = " ".join(f"word{i}" for i in range(60))
CORE = f'"""Core. {WORDS}"""\nimport util\n\n\nclass Engine:\n    """Runs things."""\n\n    def start(self, speed: int):\n        """Starts the turbine.\n        Slowly."""\n        return util.spinUp(speed)\n\n    limit = 3\n\n\ndef stopEverything():\n    return Engine()\n'
UTIL = f'"""Util. {WORDS}"""\n\n\ndef spinUp(speed):\n    """Turns the wheel."""\n    return speed\n'


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "project"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg/__init__.py").write_text("")
    (root / "pkg/_private.py").write_bytes(f"# {WORDS}\r\nx = 1\r\n# ".encode() + b"\xff\xfe bad bytes\n" + "name = 'é'\n".encode())
    (root / "core.py").write_text(CORE)
    (root / "util.py").write_text(UTIL)
    (root / "UPPER.PY").write_text(UTIL)
    (root / ".env").write_text("A=1")
    (root / "Makefile").write_text("all:\n")
    (root / "empty.md").write_text("")
    (root / "node_modules/skip.js").write_text("let a;")
    os.symlink(root / "core.py", root / "link.py")
    return root


def test_scan(spark, tree):
    files = {r.path: r for r in read_tree(spark, str(tree)).collect()}
    assert sorted(files) == ["core.py", "empty.md", "pkg/__init__.py", "pkg/_private.py", "util.py"]
    assert files["pkg/_private.py"].content == (tree / "pkg/_private.py").read_bytes()
    assert {p for p, _ in walk(str(tree))} == set(files)
    assert not is_source(".env") and not is_source("Dockerfile") and not is_source("UPPER.PY")


def test_project_root(tree, monkeypatch):
    monkeypatch.delenv("CORVINE_PROJECT_ROOT", raising=False)
    (tree / "setup.py").write_text("")
    monkeypatch.chdir(tree / "pkg")
    assert project_root() == tree.resolve()
    assert project_root(str(tree / "pkg")) == (tree / "pkg").resolve()


def test_build_search_update(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "store")).load(str(tree))
    chunks = index.table("chunks").collect()
    for c in chunks:
        raw = (tree / c.path).read_bytes()
        assert raw[c.part_start : c.part_end].decode("utf-8", "replace") == c.text or c.path == "pkg/_private.py"
    assert {(c.scope_name, c.scope_type) for c in chunks if c.path == "core.py"} >= {("Engine", "class"), ("Engine.start", "method"), ("stopEverything", "function"), ("Global", "global")}
    start = next(c for c in chunks if c.scope_name == "Engine.start")
    assert "util.py:spinUp(speed) - Turns the wheel." in start.header
    assert sum(c.scope_name == "Engine" for c in chunks) == 2

    hits = retrieve.search(index, "turbine startsSlowly spinUp", 3).collect()
    assert (hits[0].path, len(hits)) == ("core.py", 3) and "spinUp" in hits[0].content
    deep = retrieve.deep_search(index, "stopEverything", 1).first()
    assert deep.imports == ["util.py"] and [s.name for s in deep.outline] == ["Engine", "Engine.start", "stopEverything"]
    assert "core.py" in retrieve.search_markdown(index, "turbine", 2) and "Imported by: core.py" in retrieve.inspect_markdown(index, "util.py")
    assert retrieve.inspect_markdown(index, "none.py") == "No such file: none.py"

    # An update gives what a rebuild gives.
    (tree / "util.py").write_text(UTIL.replace("spinUp", "spinDown"))
    (tree / "core.py").unlink()
    now = read_tree(spark, str(tree))
    index.update(now.where("path = 'util.py'"), spark.createDataFrame([("core.py",)], "path string"))
    fresh = Index(spark, str(tmp_path / "fresh")).load(str(tree))
    assert same(index, fresh)
    before = sorted(map(str, retrieve.search(index, "spinDown", 3).collect()))
    index.compact()
    assert sorted(map(str, retrieve.search(index, "spinDown", 3).collect())) == before


def same(index, other):
    rows = lambda i, name: sorted(map(str, i.table(name).select(sorted(i.table(name).columns)).collect()))
    return all(rows(index, name) == rows(other, name) for name in ("symbols", "edges", "summaries", "chunks", "vectors", "postings", "terms", "stats"))


def test_updates_touch_what_changed(spark, tree, tmp_path, monkeypatch):
    """Only changed files, and files whose headers hang on them, are cut and embedded again; dead rows are compacted when there are too many; nothing unused stays."""
    for i in range(40):
        (tree / f"alone{i}.md").write_text(f"About subject{i}. {WORDS}")
    (tree / "other.py").write_text(f'"""Other. {WORDS}"""\n\n\ndef apart():\n    return 1\n')
    index = Index(spark, str(tmp_path / "store")).load(str(tree))
    seen, embedded = [], plans.dense.embedded
    monkeypatch.setattr(plans.dense, "embedded", lambda chunks, *rest: (seen.append({c.chunk_uid for c in chunks.select("chunk_uid").collect()}), embedded(chunks, *rest))[1])
    paths = lambda uids: {c.path for c in index.table("chunks").collect() if c.chunk_uid in uids}
    none = spark.createDataFrame([], "path string")

    # The one that imports it has its header.
    (tree / "util.py").write_text(UTIL.replace("Turns the wheel", "Turns it"))
    index.update(read_tree(spark, str(tree)).where("path = 'util.py'"), none)
    assert paths(seen[-1]) == {"util.py", "core.py"}
    dead = index.store.manifest()["numbers"]["dead"]
    assert dead > 1 and len(index.store.manifest()["tables"]["chunks"]) == 2
    # A file that nothing imports stays alone; its dead row is one too many.
    index.most_dead = dead
    (tree / "alone0.md").write_text(f"About nothing. {WORDS}")
    index.update(read_tree(spark, str(tree)).where("path = 'alone0.md'"), none)
    assert paths(seen[-1]) == {"alone0.md"} and index.store.manifest()["numbers"]["dead"] == 0 and len(index.store.manifest()["tables"]["chunks"]) == 1
    # A new file that an import resolves to now.
    (tree / "other.py").write_text(f'"""Other. {WORDS}"""\nimport later\n\n\ndef apart():\n    return later.come(2)\n')
    index.update(read_tree(spark, str(tree)).where("path = 'other.py'"), none)
    (tree / "later.py").write_text(f'"""Later. {WORDS}"""\n\n\ndef come(n):\n    """Comes at last."""\n')
    index.update(read_tree(spark, str(tree)).where("path = 'later.py'"), none)
    assert paths(seen[-1]) == {"later.py", "other.py"}
    assert "Comes at last." in next(c.header for c in index.table("chunks").collect() if c.scope_name == "apart")
    assert same(index, Index(spark, str(tmp_path / "fresh")).load(str(tree)))
    with index:
        (tmp_path / "store/files/v=999").mkdir()
    for table, versions in {**index.store.manifest()["tables"], **index.store.manifest()["gone"]}.items():
        assert {f.name for f in (tmp_path / "store" / table).iterdir()} == {f"v={v}" for v in versions}


def test_searches_read_by_key(spark, tree, tmp_path):
    """Plans of a search: postings by the query's terms, file contents by the hits' paths."""
    index = Index(spark, str(tmp_path / "store")).load(str(tree))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    hits = plan(retrieve.sparse_hits(index, "turbine wheel", 5))
    assert "PushedFilters: [In(term, [turbine,wheel])]" in hits and "content" not in hits and "tokens" not in hits
    scans = [part.split("\n")[0] for part in plan(retrieve.search(index, "turbine", 2)).split("FileScan")[1:]]
    read = [scan for scan in scans if "content:binary" in scan]
    assert read and all("In(path, [" in scan or "EqualTo(path," in scan for scan in read)
    uid = index.table("chunks").first().chunk_uid
    assert index.chunk(uid).count() == 1 and "EqualTo(chunk_uid" in plan(index.chunk(uid))


def test_plugged_in(spark, tree, tmp_path):
    """An extractor for another file type, and subword tokens, reach chunks and symbols."""

    # Workers can't import this module, so the class goes to them by value.
    class TaskNotes:
        """A symbol extractor of one's own: lines that begin with TODO are functions."""

        def extract(self, path, text):
            from corvine.operators.symbols import _symbol

            return [_symbol("function", "", line.split()[1], n, n) for n, line in enumerate(text.split("\n"), 1) if line.startswith("TODO ")]

    (tree / "plan.txt").write_text(f"TODO water the garden\n{WORDS}\nTODO rest\n")
    vocabulary = "/opt/tokenizers/byte_bpe_50k.json"
    tokenizer = BpeTokenizer(vocabulary) if os.path.exists(vocabulary) else None
    index = Index(spark, str(tmp_path / "store"), tokenizer=tokenizer, extractors={".txt": TaskNotes()}).load(str(tree))
    assert {(s.name, s.start_line) for s in index.table("symbols").where("path = 'plan.txt'").collect()} == {("water", 1), ("rest", 3)}
    assert {c.scope_name for c in index.table("chunks").where("path = 'plan.txt'").collect()} == {"water", "Global", "rest"}
    if tokenizer:
        text = "spinUp(é) of the turbine"
        spans = tokenizer.spans(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and len(spans) > 5 and tokenizer.spans("") == []


def test_watch(spark, tree, tmp_path):
    index = Index(spark, str(tmp_path / "store")).load(str(tree))

    def catch_up():
        watch(index, str(tree), str(tmp_path / "checkpoint"), processingTime="1 second").processAllAvailable()
        for q in spark.streams.active:
            q.processAllAvailable()
            q.stop()
            q.awaitTermination()

    catch_up()
    (tree / "fresh.py").write_text(UTIL.replace("spinUp", "brandNew"))
    (tree / "core.py").unlink()
    catch_up()
    paths = {r.path for r in index.table("files").select("path").collect()}
    assert "fresh.py" in paths and "core.py" not in paths
    assert retrieve.search(index, "brandNew", 1).first().path == "fresh.py"
    assert same(index, Index(spark, str(tmp_path / "again")).load(str(tree)))
    version = index.store.version()
    catch_up()
    assert index.store.version() == version


def test_an_index_that_only_grows(spark, tmp_path, monkeypatch):
    """New files, one update each: nothing is dead, and still segments stay few, and it is what a rebuild gives."""
    monkeypatch.setattr(plans, "MOST_SEGMENTS", 1)
    files = [(f"f{i}.md", ".md", b"", 60, "", 0) for i in range(3)]
    files = [(p, e, " ".join(f"word{i}x{j}" for j in range(60)).encode(), n, f"m{i}", t) for i, (p, e, _, n, _, t) in enumerate(files)]
    frame = lambda rows: spark.createDataFrame(rows, FILES)
    grown, built = Index(spark, str(tmp_path / "grown")), Index(spark, str(tmp_path / "built"))
    grown.replace(frame(files[:1]))
    for f in files[1:]:
        grown.update(frame([f]), spark.createDataFrame([], "path string"))
        assert max(map(len, grown.store.manifest()["tables"].values())) == 1
    built.replace(frame(files))
    for name in ("chunks", "postings", "terms"):
        x, y = grown.table(name), built.table(name)
        assert x.count() == y.count() and x.exceptAll(y.select(x.columns)).count() == 0
