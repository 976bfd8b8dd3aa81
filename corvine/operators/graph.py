"""Imports, the file graph they form, and calls resolved along it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cleaned_import, decoded, file_name, stem, suffix
from ..schemas import IMPORTS
from .imports import BY_SUFFIX, imported


def imports(files: DataFrame) -> DataFrame:
    """From path, ext and content, the import strings in file order, each once: IMPORTS."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, ext, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                lang, found = imported(ext, text or "")
                rows += [(path, i, raw, lang) for i, raw in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "ordinal", "raw", "lang"])

    return files.where(F.col("ext").isin(*BY_SUFFIX)).select("path", "ext", decoded(F.col("content"))).mapInArrow(run, IMPORTS)


def python_modules(files: DataFrame) -> DataFrame:
    """name -> target: full dotted paths first, then every dotted end of them; of several files the first path. Packages go by their folder, too."""
    dotted = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    py = files.where(F.col("path").endswith(".py")).select("path", F.regexp_replace(dotted, r"\.__init__$", "").alias("module"), dotted.alias("as_is"))
    full = py.select("path", F.explode(F.array_distinct(F.array("module", "as_is"))).alias("full"))
    parts = full.select("path", "full", F.posexplode(F.split("full", r"\.")).alias("i", "_p"))
    names = parts.select("path", F.array_join(F.slice(F.split("full", r"\."), F.col("i") + 1, F.lit(2**31 - 1)), ".").alias("name"), (F.col("i") > 0).cast("int").alias("partial"))
    return names.groupBy("name").agg(F.min(F.struct("partial", "path")).alias("best")).select("name", F.col("best.path").alias("target"))


def file_keys(files: DataFrame) -> DataFrame:
    """name -> target for other languages: stem, file name and path without suffix; of several files the last path."""
    bare = F.substring("path", F.lit(1), F.length("path") - F.length(suffix(F.col("path"))))
    keys = files.select("path", F.explode(F.array_distinct(F.array(stem(F.col("path")), file_name(F.col("path")), bare))).alias("name"))
    return keys.groupBy("name").agg(F.max("path").alias("target"))


def candidates(found: DataFrame) -> DataFrame:
    """Keys to try for an import string of another language, in order: as cleaned, with slashes for dots, its last part's stem."""
    clean = cleaned_import(F.col("raw"))
    base = file_name(clean)
    last = F.when(clean.contains("/"), F.substring(base, F.lit(1), F.length(base) - F.length(suffix(clean)))).otherwise(clean)
    tries = F.array(clean, F.replace(clean, F.lit("."), F.lit("/")), last)
    return found.select("path", "ordinal", F.posexplode(tries).alias("prio", "name"))


def edges(files: DataFrame, found: DataFrame) -> DataFrame:
    """src, dst and ordinal: each import resolved to a file of the tree, not the importing one, each pair once."""
    python = found.where("lang = 'python'").join(python_modules(files), F.col("raw") == F.col("name")).select(F.col("path").alias("src"), F.col("target").alias("dst"), "ordinal")
    others = candidates(found.where("lang <> 'python'")).join(file_keys(files), "name").where("target <> path")
    others = others.groupBy("path", "ordinal").agg(F.min_by("target", "prio").alias("dst")).select(F.col("path").alias("src"), "dst", "ordinal")
    return python.where("src <> dst").unionByName(others).groupBy("src", "dst").agg(F.min("ordinal").alias("ordinal"))


def neighbours(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """path, imports (in import order) and imported_by (in path order) of the nodes, a few files; only their own links become lists."""
    listed = lambda c, o: F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(c).alias("p")))), lambda s: s["p"])
    out = links.join(nodes.select(F.col("path").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("path")).agg(listed("dst", "ordinal").alias("imports"))
    back = links.join(nodes.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast("array<string>")
    return nodes.select("path").join(out, "path", "left").join(back, "path", "left").select("path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def reversed_links(links: DataFrame) -> DataFrame:
    """dst and src of all links, a row for each: whatever many files link to is as many rows, not one long list."""
    return links.select("dst", "src").distinct()


def resolved_calls(calls: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """path, scope, callee -> the one symbol it means: target, owner, kind, args, docstring.

    Looked for in the file itself, then in what it imports, in import order; functions before methods, then as listed.
    calls: path, scope, callee. symbols: path, name, kind, owner, args, docstring, ordinal. links: src, dst, ordinal.
    """
    own = calls.select("path").distinct().select("path", F.col("path").alias("target"), F.lit(-1).alias("near"))
    scope = own.unionByName(links.select(F.col("src").alias("path"), F.col("dst").alias("target"), F.col("ordinal").cast("int").alias("near")))
    named = symbols.where("kind in ('function', 'method')").select(F.col("path").alias("target"), F.col("name").alias("callee"), "kind", "owner", "args", "docstring", "ordinal")
    met = calls.join(scope, "path").join(named, ["target", "callee"])
    best = F.min(F.struct("near", "kind", "ordinal", "target", "owner", "args", "docstring")).alias("b")
    return met.groupBy("path", "scope", "callee").agg(best).select("path", "scope", "callee", "b.target", "b.kind", "b.owner", "b.args", "b.docstring")


def resolved_paths(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked -> path: the same path, else with / for backslashes, else the first known path that ends with it."""
    want = F.replace("asked", F.lit("\\"), F.lit("/"))
    # A known path is found by each of its ends, so ends join as keys; of each end the best path is kept before that.
    ends = known.select("path", F.posexplode(F.split("path", "/")).alias("i", "_p"))
    ends = ends.select("path", F.array_join(F.slice(F.split("path", "/"), F.col("i") + 1, F.lit(2**31 - 1)), "/").alias("want"), (F.col("i") > 0).cast("int").alias("rank"))
    best = ends.join(asked.select(want.alias("want")).distinct(), "want", "left_semi").groupBy("want").agg(F.min(F.struct("rank", "path")).alias("b"))
    return asked.select("asked", want.alias("want")).join(best, "want").select("asked", "b.path")
