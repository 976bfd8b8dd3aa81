"""The index of a source tree: files, symbols, edges, chunks, postings and vectors.

Everything is derived from the files table by set-based plans. An update derives again what depends on
the files that changed, and nothing else, so that it gives what a rebuild gives.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.protocols import Embedder, HashedEmbedder, Tokenizer, WordTokenizer
from ..functions.text import decoded, estimated_tokens, file_name, tokens
from ..operators import chunking, dense, graph, sparse, symbols, versions
from ..schemas import FILES
from ..sources.tree import read_tree
from .store import SnapshotStore

STATS = "n_files long, n_symbols long, n_edges long, n_docs long, n_tokens long, total_len long, avgdl double, mean_idf double"
PARTS = "path string, island int, part int, token_start int, part_start long, part_end long, part_text string"


def _measured(tokenizer: Tokenizer):
    def run(batches):
        for batch in batches:
            counts = [len(tokenizer.spans(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["path", "n_tokens"])

    return run


def _cut(tokenizer: Tokenizer, budget: int, overlap: int):
    """Blocks that fit with their header stay whole; others are cut into overlapping windows of tokens with true byte ranges."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, island, header, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                spans, head = tokenizer.spans(text), len(tokenizer.spans(header))
                if head + len(spans) <= budget:
                    rows.append((path, island, 0, 0, 0, len(text.encode()), text))
                    continue
                size = max(chunking.LEAST_WINDOW, budget - head)
                step = max(1, size - min(overlap, size // 2))
                for part, at in enumerate(range(0, len(spans), step)):
                    a, b = spans[at][0], spans[min(at + size, len(spans)) - 1][1]
                    start = len(text[:a].encode())
                    rows.append((path, island, part, at, start, start + len(text[a:b].encode()), text[a:b]))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in PARTS.split(", ")])

    return run


def headers(blocks: DataFrame, calls: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """path, island and header: where a block is, what it calls, and the signature and first doc line of each."""
    known = graph.resolved_calls(calls, found, links)
    name = F.concat(file_name(F.col("target")), F.lit(":"), F.when(F.col("owner") != "", F.concat("owner", F.lit("."))).otherwise(""), "callee")
    doc = F.split("docstring", "\n")[0]
    line = F.concat(F.lit("uses "), name, F.lit("("), F.col("args"), F.lit(")"), F.when(doc != "", F.concat(F.lit(" - "), doc)).otherwise(""))
    uses = known.select("path", F.col("scope").alias("ordinal"), F.struct("callee", line.alias("line")).alias("use")).groupBy("path", "ordinal").agg(F.array_sort(F.collect_list("use")).alias("uses"))
    joined = blocks.join(uses, ["path", "ordinal"], "left")
    place = F.concat(F.lit("in "), file_name(F.col("path")), F.lit(" at "), F.col("scope_name"))
    return joined.select("path", "island", F.concat(F.concat_ws("\n", F.array(place), F.transform("uses", lambda u: u["line"])), F.lit("\n")).alias("header"))


def chunked(files: DataFrame, found: DataFrame, links: DataFrame, tokenizer: Tokenizer, budget: int = chunking.MAX_TOKENS, overlap: int = chunking.OVERLAP, least: int = chunking.LEAST_FILE) -> DataFrame:
    """chunk_uid, path, chunk_id, scope, byte ranges of block and part, header, text; of files with `least` tokens or more.

    found: symbols of these files, and of those that they import.
    """
    own = found.join(files.select("path"), "path", "left_semi")
    text = files.select("path", decoded(F.col("content")).alias("text"), "content")
    long_enough = text.select("path", "text").mapInArrow(_measured(tokenizer), "path string, n_tokens int").where(F.col("n_tokens") >= least).select("path")
    text = text.join(long_enough, "path", "left_semi")
    # Offsets count the file's own bytes, whether or not they are valid UTF-8.
    raw = chunking.line_ranges(text, "path", "content", with_text=True)
    sized = raw.select("path", "line", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), decoded(F.col("line_bytes")).alias("line_text"))
    counts = sized.groupBy("path").agg(F.max("line").alias("n_lines"))
    scopes = own.select("path", F.when(F.col("owner") != "", F.concat("owner", F.lit("."), "name")).otherwise(F.col("name")).alias("name"), "kind", "start_line", "end_line", "ordinal")
    runs = chunking.islands(chunking.deepest_scopes(scopes, counts), sized)
    within = runs.select("path", "island", "scope_name", "scope_type", "ordinal", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    entries = F.array_sort(F.collect_list(F.struct("line", "line_text")))
    blocks = within.join(sized, ["path", "line"]).groupBy("path", "island", "scope_name", "scope_type", "ordinal").agg(
        F.min("start").alias("byte_start"), F.max("end").alias("byte_end"), F.array_join(F.transform(entries, lambda e: e["line_text"]), "\n").alias("block")
    )
    calls = own.select("path", F.col("ordinal").alias("scope"), F.explode("calls").alias("callee"))
    headed = blocks.join(headers(blocks, calls, found, links), ["path", "island"])
    parts = headed.select("path", "island", "header", "block").mapInArrow(_cut(tokenizer, budget, overlap), PARTS)
    joined = headed.join(parts, ["path", "island"])
    number = F.row_number().over(Window.partitionBy("path").orderBy("island", "part")) - 1
    return joined.withColumn("chunk_id", number.cast("int")).select(
        F.xxhash64("path", "chunk_id").alias("chunk_uid"), "path", "chunk_id", "scope_name", "scope_type", "byte_start", "byte_end",
        (F.col("byte_start") + F.col("part_start")).alias("part_start"), (F.col("byte_start") + F.col("part_end")).alias("part_end"),
        estimated_tokens(F.concat("header", "part_text")).alias("est_tokens"), "header", F.col("part_text").alias("text"),
    )


#: Tables whose rows belong to files, by the `gone` list that replaces their rows; and tables that every commit writes anew.
GROUPS = {
    "files": "gone_files", "symbols": "gone_files", "imports": "gone_files", "summaries": "gone_files",
    "chunks": "gone_chunks", "vectors": "gone_chunks", "postings": "gone_chunks",
}
WHOLE = ("edges", "terms", "stats")
#: How segments are sorted, and what is looked up in them.
LAYOUT = {
    "files": ("path", ("path",)), "symbols": ("path", ("path",)), "imports": ("path", ()), "summaries": ("path", ("path",)),
    "chunks": ("path", ("path", "chunk_uid")), "vectors": (None, ()), "postings": ("term", ("term",)), "edges": ("src", ("src", "dst")), "terms": ("term", ("term",)), "stats": (None, ()),
}


#: A reader joins each segment with the lists of what later ones replaced, so this bounds its joins however often an index is updated.
MOST_SEGMENTS = 12


class Index:
    """An index of one project in a snapshot store. Several can live side by side; nothing is global.

    A commit derives what belongs to changed files: their symbols, imports and summaries; and the
    chunks, vectors and postings of these and of files whose headers depend on them, which are files
    that import them, before or after, or whose own imports resolve differently now. Edges are resolved
    again from stored import strings; document frequencies and totals change by what comes and goes.
    Dead rows stay in old segments until there are more than `most_dead`, or a fifth of all, or a table has
    more than MOST_SEGMENTS segments, dead rows or not; then the segments are written as one.
    """

    def __init__(self, spark: SparkSession, store: str, embedder: Embedder | None = None, tokenizer: Tokenizer | None = None, extractors: dict | None = None, most_dead: int = versions.MOST_DEAD):
        self.spark, self.store = spark, SnapshotStore(spark, store)
        self.embedder, self.tokenizer, self.extractors, self.most_dead = embedder or HashedEmbedder(), tokenizer or WordTokenizer(), extractors, most_dead

    def __enter__(self) -> Index:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Deletes what failed commits left behind. Nothing else is held: an index can be used again after it."""
        if self.store.version():
            self.store.drop_unused()

    def build(self, root: str) -> int:
        return self.replace(read_tree(self.spark, root))

    def replace(self, files: DataFrame) -> int:
        """An index of these files (rows of FILES) only, whatever was indexed before."""
        manifest = self.store.manifest()
        version = self._commit(files, None, {**manifest, "tables": {}, "gone": {}, "numbers": {}})
        self.store.drop_unused()
        return version

    def update(self, changed: DataFrame, deleted: DataFrame) -> int:
        """changed: rows of FILES; deleted: path. What an update gives is what a rebuild gives."""
        gone = changed.select("path").unionByName(deleted.select("path")).distinct()
        version = self._commit(changed, gone, self.store.manifest())
        numbers = self.store.manifest()["numbers"]
        segments = max(len(self.store.manifest()["tables"][t]) for t in GROUPS)
        if segments > MOST_SEGMENTS or numbers["dead"] > self.most_dead or numbers["dead"] > versions.DEAD_SHARE * numbers["rows"]:
            version = self.compact()
        return version

    def _commit(self, files: DataFrame, gone: DataFrame | None, manifest: dict) -> int:
        known, n = manifest["tables"], manifest["version"] + 1
        before = lambda name: self.store.read(name, GROUPS.get(name), manifest) if name in known else None
        stage = lambda name, df: self.store.stage(name, n, df, *LAYOUT[name])
        left = lambda name, by: None if before(name) is None else before(name).join(by, "path", "left_anti")
        now = lambda name, new, by: new if before(name) is None else left(name, by).unionByName(new.select(before(name).columns))

        first = gone is None
        files = stage("files", files.select(FILES.names))
        gone = self.store.stage("gone_files", n, gone if gone is not None else files.select("path").limit(0))
        found = stage("symbols", symbols.symbols(files, self.extractors))
        raw = stage("imports", graph.imports(files))
        stage("summaries", symbols.summaries(files, found))
        all_files, all_found = now("files", files, gone), now("symbols", found, gone)
        links = stage("edges", graph.edges(all_files.select("path"), now("imports", raw, gone)))

        if first:
            dirty, gone_chunks = files, gone
        else:
            old = before("edges")
            turned = links.exceptAll(old).unionByName(old.exceptAll(links)).select(F.col("src").alias("path"))
            importers = links.unionByName(old).join(gone.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"))
            gone_chunks = gone.unionByName(turned).unionByName(importers).distinct()
            gone_chunks = self.store.stage("gone_chunks", n, gone_chunks)
            dirty = all_files.join(gone_chunks, "path", "left_semi")
        if first:
            gone_chunks = self.store.stage("gone_chunks", n, gone_chunks)
        whole = F.concat("header", "text")
        chunks = chunked(dirty, all_found, links, self.tokenizer).withColumn("tokens", tokens(whole)).withColumn("doc_len", F.size("tokens").cast("long"))
        chunks = stage("chunks", chunks)
        paths = chunks.select("chunk_uid", "path")
        stage("vectors", dense.embedded(chunks.select("chunk_uid", whole.alias("text")), self.embedder, "chunk_uid").join(paths, "chunk_uid"))
        stage("postings", sparse.postings(chunks, "chunk_uid", "path"))

        dropped = before("chunks").join(gone_chunks, "path", "left_semi") if not first else None
        changes = sparse.document_frequency(chunks)
        if dropped is not None:
            less = sparse.document_frequency(dropped).withColumn("df", -F.col("df"))
            changes = before("terms").unionByName(changes).unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        terms = stage("terms", changes)
        numbers = dict(manifest["numbers"]) or {"dead": 0, "rows": 0, "n_docs": 0, "total_len": 0, "n_tokens": 0, "n_symbols": 0, "n_files": 0}
        self._count(numbers, 1, files, found, chunks)
        if not first:
            self._count(numbers, -1, before("files").join(gone, "path", "left_semi"), before("symbols").join(gone, "path", "left_semi"), dropped)
            numbers["dead"] += dropped.count()
        numbers["rows"] = numbers["n_docs"] + numbers["dead"]
        mean = terms.agg(F.avg(sparse.raw_idf(F.lit(numbers["n_docs"]), F.col("df")))).first()[0]
        n_edges = links.count()
        stage("stats", self.spark.createDataFrame([(numbers["n_files"], numbers["n_symbols"], n_edges, numbers["n_docs"], numbers["n_tokens"], numbers["total_len"], numbers["total_len"] / max(numbers["n_docs"], 1), mean)], STATS).coalesce(1))

        manifest = {"version": n, "tables": {t: [n] for t in WHOLE}, "gone": {g: [*manifest["gone"].get(g, []), n] for g in set(GROUPS.values())}, "numbers": numbers}
        manifest["tables"] |= {t: [*known.get(t, []), n] for t in GROUPS}
        self.store.publish(manifest)
        self.store.drop_unused()
        return n

    @staticmethod
    def _count(numbers: dict, sign: int, files: DataFrame, found: DataFrame, chunks: DataFrame) -> None:
        """Adds files, symbols and chunks to the index's numbers, or takes them away."""
        c = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length"), F.coalesce(F.sum("est_tokens"), F.lit(0)).alias("tokens")).first()
        for name, value in (("n_files", files.select("path").count()), ("n_symbols", found.select("path").count()), ("n_docs", c.n), ("total_len", c.length), ("n_tokens", c.tokens)):
            numbers[name] += sign * value

    def compact(self) -> int:
        """Writes each table's live rows as one segment; nothing that is read changes, and dead rows go."""
        manifest = self.store.manifest()
        n = manifest["version"] + 1
        for name, group in GROUPS.items():
            self.store.stage(name, n, self.store.read(name, group, manifest), *LAYOUT[name])
        numbers = {**manifest["numbers"], "dead": 0, "rows": manifest["numbers"]["n_docs"]}
        self.store.publish({"version": n, "tables": {**manifest["tables"], **{t: [n] for t in GROUPS}}, "gone": {}, "numbers": numbers})
        self.store.drop_unused()
        return n

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, GROUPS.get(name))

    def chunk(self, uid: int) -> DataFrame:
        """The chunk of this number, found by its key's Bloom filters."""
        return self.table("chunks").where(F.col("chunk_uid") == uid)

    def stats(self) -> DataFrame:
        """One row: files, symbols, edges, chunks and estimated tokens of the index, and what BM25 needs."""
        return self.table("stats")

    def load(self, root: str) -> Index:
        """This index, built first if it never was."""
        if not self.store.version():
            self.build(root)
        return self
