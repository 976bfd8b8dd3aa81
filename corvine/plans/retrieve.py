"""Searches over an index: hybrid hits, file inspection, outlines; markdown is a thin last step over a few rows.

A search reads the postings of the query's terms, their document frequencies and one row of totals;
the vectors; and, of the few best chunks, their rows and their files' bytes, by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decoded, numbered, spliced, tokens
from ..operators import dense, fusion, graph, sparse
from .index import Index


def query_tokens(index: Index, query: str) -> list[str]:
    return index.spark.range(1).select(tokens(F.lit(query)).alias("t")).first().t


def sparse_hits(index: Index, query: str, depth: int) -> DataFrame:
    """chunk_uid and score of the `depth` best chunks by BM25, from the stored postings of the query's terms."""
    asked = query_tokens(index, query) or [""]
    stats = index.stats().first()
    known = {r.term: r.df for r in index.table("terms").where(F.col("term").isin(asked)).collect()}
    weights = sparse.floored(known, stats.n_docs, stats.mean_idf)
    hits = index.table("postings").where(F.col("term").isin(asked)).select("chunk_uid", "term", "doc_len")
    return sparse.top(sparse.scored(hits, weights, stats.avgdl, "chunk_uid"), depth, "chunk_uid")


def best_chunks(index: Index, query: str, k: int) -> list:
    """chunk_uid, fusion_score and ranks of the k best chunks: a few rows, on the driver.

    Both sides give fusion.DEPTH * k candidates; a query without a known term leaves the dense side alone.
    """
    depth = fusion.DEPTH * k
    vector = index.embedder.embed([query])[0].tolist()
    near = dense.nearest(index.table("vectors"), vector, depth, key="chunk_uid")
    match = sparse_hits(index, query, depth)
    return fusion.fused(fusion.ranked(near, "chunk_uid", "d2", "chunk_uid"), fusion.ranked(match, "chunk_uid", F.desc("score"), F.col("chunk_uid")), k, "chunk_uid").collect()


def search(index: Index, query: str, k: int = 5) -> DataFrame:
    """path, chunk_id, tokens, fusion_score, file_summary, content of the k best chunks, best first.

    Content is the header and the whole block, cut from the indexed bytes.
    """
    hits = best_chunks(index, query, k)
    chunks = index.table("chunks").where(F.col("chunk_uid").isin([h.chunk_uid for h in hits]))
    paths = [r.path for r in chunks.select("path").distinct().collect()]
    scores = index.spark.createDataFrame([(h.chunk_uid, h.fusion_score) for h in hits], "chunk_uid long, fusion_score double")
    named = lambda name: index.table(name).where(F.col("path").isin(paths))
    full = chunks.join(F.broadcast(scores), "chunk_uid").join(named("summaries"), "path", "left").join(named("files").select("path", "content"), "path", "left")
    content = F.concat("header", spliced(F.col("content"), F.col("byte_start"), F.col("byte_end")))
    return full.select("path", "chunk_id", F.col("est_tokens").alias("tokens"), "fusion_score", F.coalesce("summary", F.lit("")).alias("file_summary"), content.alias("content")).orderBy(F.desc("fusion_score"), "path", "chunk_id")


def _nodes(index: Index, paths: list[str]) -> DataFrame:
    return index.spark.createDataFrame([(p,) for p in paths], "path string")


def _links(index: Index, paths: list[str]) -> DataFrame:
    """Imports and importers of some files, from their own edges only."""
    near = index.table("edges").where(F.col("src").isin(paths) | F.col("dst").isin(paths))
    return graph.neighbours(_nodes(index, paths), near)


def inspect(index: Index, path: str) -> dict[str, DataFrame]:
    """One file by its path or the end of it: lines with numbers, its summary, and what it imports and is imported by. All empty if there is none."""
    asked = index.spark.createDataFrame([(path,)], "asked string")
    paths = [r.path for r in graph.resolved_paths(asked, index.table("summaries").select("path")).select("path").collect()]
    lines = index.table("files").where(F.col("path").isin(paths)).select("path", F.posexplode(F.split(decoded(F.col("content")), "\n", -1)).alias("i", "text"))
    return {
        "lines": lines.select("path", (F.col("i") + 1).alias("line"), numbered(F.col("i") + 1, F.col("text")).alias("numbered")).orderBy("line"),
        "summary": index.table("summaries").where(F.col("path").isin(paths)),
        "links": _links(index, paths),
    }


def deep_search(index: Index, query: str, k: int = 2) -> DataFrame:
    """The hits of `search` with each file's outline (classes, methods and functions by line) and links."""
    hits = search(index, query, k)
    paths = [r.path for r in hits.select("path").distinct().collect()]
    entry = F.struct("start_line", "end_line", "kind", F.when(F.col("owner") != "", F.concat("owner", F.lit("."), "name")).otherwise(F.col("name")).alias("name"), "args", "is_async")
    outline = index.table("symbols").where(F.col("path").isin(paths)).groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("outline"))
    return hits.join(outline, "path", "left").join(_links(index, paths), "path", "left").orderBy(F.desc("fusion_score"), "path", "chunk_id")


def search_markdown(index: Index, query: str, k: int = 4) -> str:
    rows = search(index, query, k).collect()
    if not rows:
        return f"No results for: {query}"
    return "\n\n".join(f"## {i}. {r.path} (chunk {r.chunk_id}, score {r.fusion_score:.4f})\n{r.file_summary}\n\n```\n{r.content}\n```" for i, r in enumerate(rows, 1))


def inspect_markdown(index: Index, path: str) -> str:
    parts = inspect(index, path)
    lines = parts["lines"].collect()
    if not lines:
        return f"No such file: {path}"
    summary, links = parts["summary"].first(), parts["links"].first()
    listed = lambda names: ", ".join(names) or "none"
    return f"# {lines[0].path}\n{summary.summary}\n\nImports: {listed(links.imports)}\nImported by: {listed(links.imported_by)}\n\n```\n" + "\n".join(r.numbered for r in lines) + "\n```"


def deep_search_markdown(index: Index, query: str, k: int = 2) -> str:
    rows = deep_search(index, query, k).collect()
    if not rows:
        return f"No results for: {query}"
    out = []
    for i, r in enumerate(rows, 1):
        outline = "\n".join(f"- {s.start_line}-{s.end_line} {'async ' if s.is_async else ''}{s.kind} {s.name}({s.args})" for s in r.outline or [])
        out.append(f"## {i}. {r.path} (score {r.fusion_score:.4f})\n```\n{r.content}\n```\n{outline}\nImports: {', '.join(r.imports or []) or 'none'}\nImported by: {', '.join(r.imported_by or []) or 'none'}")
    return "\n\n".join(out)
