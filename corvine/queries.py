"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.protocols import WordTokenizer
from .operators import chunking, dense, fusion, graph, sparse, symbols, versions
from .plans import index, retrieve
from .plans.store import SnapshotStore, scratch
from .streaming import live

#: Words of middling frequency in the tables' invented prose, and one in most documents, whose IDF is floored.
QUERY = ["onthe", "thnt", "herewh", "des", "the", "nosuchterm"]
K = 10
WINDOW, OVERLAP = 250, 50
DEBOUNCE_SECONDS = 6 * 3600

WORDS = ["parseHttpRequest", "HTTPServer", "getHTTPs", "snake_case_name", "simple", "XMLParser2", "iOS9App", "ALLCAPS", "Capital", "éclairShop", "a1B2c3", "already lower words"]
SCOPES = [
    ("a.py", "Engine", "class", 3, 20, 0), ("a.py", "Engine.start", "method", 5, 9, 1), ("a.py", "Engine.stop", "method", 12, 18, 2), ("a.py", "helper", "function", 22, 30, 3), ("a.py", "helper_twin", "function", 22, 30, 4),
    ("b.py", "run", "function", 1, 4, 0), ("b.py", "Deep", "class", 6, 40, 1), ("b.py", "Deep.inner", "method", 8, 12, 2), ("c.md", "none", "function", 90, 99, 0),
]
FILE_LINES = [("a.py", 32), ("b.py", 14), ("c.md", 5)]
CALLS = [("app.py", 1, "load"), ("app.py", 1, "save"), ("app.py", 2, "close"), ("app.py", 2, "nowhere"), ("lib/io.py", 5, "load"), ("lib/db.py", 3, "save")]
SYMBOLS = [
    ("app.py", "close", "method", "App", "timeout", "Closes it.", 1), ("lib/io.py", "load", "function", "", "path", "Reads.", 0), ("lib/io.py", "save", "method", "Disk", "path, data", "", 2), ("lib/io.py", "save", "function", "", "data", "Writes.", 4),
    ("lib/db.py", "load", "function", "", "table", "", 0), ("lib/db.py", "save", "function", "", "row", "", 1), ("lib/db.py", "close", "function", "", "", "", 2),
]
LINKS = [("app.py", "lib/db.py", 0), ("app.py", "lib/io.py", 3), ("lib/io.py", "lib/db.py", 1)]
SOURCE_FILES = [
    ("pkg/__init__.py", "from pkg import core\nimport pkg.util\n"), ("pkg/core.py", "import util\nfrom pkg.util import helper\nimport json\n"), ("pkg/util.py", "import pkg.core\nimport pkg.util\n"),
    ("web/main.ts", "import { a } from './lib/tools';\nconst b = require('../web/view');\nimport z from 'zlib';\n"), ("web/lib/tools.ts", "export const a = 1;\n"), ("web/view.js", "import m from './main'\n"),
    ("c/main.c", "#include \"list.h\"\n#include <stdio.h>\nint main() { return 0; }\n"), ("c/list.h", "struct list { int n; };\n"), ("r/app.rb", "require_relative 'model'\n"), ("r/model.rb", "class Model\n  def save(x)\n  end\nend\n"),
]
IMPORT_EDGES = [
    ("pkg/__init__.py", "pkg/util.py"), ("pkg/core.py", "pkg/util.py"), ("pkg/util.py", "pkg/core.py"), ("web/main.ts", "web/lib/tools.ts"), ("web/main.ts", "web/view.js"), ("web/view.js", "web/main.ts"), ("c/main.c", "c/list.h"), ("r/app.rb", "r/model.rb"),
]


def _sql(value) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS v({columns})"


def literal(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values(rows, columns)}") if not any("\n" in str(x) for r in rows for x in r) else spark.createDataFrame(rows, columns.split(", "))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_PARTS = r"list_filter(string_split(regexp_replace(regexp_replace({w}, '([A-Z]+)', ' \1', 'g'), '([A-Z][a-z]+)', ' \1', 'g'), ' '), lambda p: p <> '')"
_SUBWORDS = "CASE WHEN len({parts}) > 1 THEN list_concat([lower({w})], list_transform({parts}, lambda q: lower(q))) ELSE [lower({w})] END"
_TOKENS = "list_distinct(flatten(list_transform(regexp_extract_all(coalesce({t}, ''), '[A-Za-z0-9]+'), lambda w: " + _SUBWORDS.format(parts=_PARTS.format(w="w"), w="w") + ")))"
_TOKENISED = f"tok AS MATERIALIZED (SELECT doc_id, {_TOKENS.format(t='text')} AS tokens FROM documents), len AS (SELECT doc_id, CAST(len(tokens) AS BIGINT) AS doc_len FROM tok), terms AS (SELECT doc_id, unnest(tokens) AS term FROM tok)"
_STATS = "stats AS (SELECT count(*) AS n_docs, CAST(sum(doc_len) AS BIGINT) AS total_len, sum(doc_len) / greatest(count(*), 1)::DOUBLE AS avgdl FROM len)"
_IDF = (
    "df AS MATERIALIZED (SELECT term, count(*) AS df FROM terms GROUP BY term), "
    "raw AS MATERIALIZED (SELECT term, df, ln(greatest(0.5::DOUBLE, n_docs - df + 0.5::DOUBLE)) - ln(greatest(0.5::DOUBLE, df + 0.5::DOUBLE)) AS raw FROM df, stats), "
    "mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw), "
    "idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * mean ELSE raw END AS idf FROM raw, mean)"
)
_SCORES = (
    "scored AS (SELECT t.doc_id, round(sum(i.idf * 2.5::DOUBLE / (1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.doc_len / s.avgdl))), 6) AS score "
    f"FROM terms t JOIN idf i ON t.term = i.term JOIN len l ON l.doc_id = t.doc_id, stats s WHERE t.term IN ({', '.join(map(_sql, QUERY))}) GROUP BY t.doc_id)"
)
_BM25 = f"WITH {_TOKENISED}, {_STATS}, {_IDF}, {_SCORES} "


@query(f"SELECT doc_id, CAST(len({_TOKENS.format(t='text')}) AS BIGINT) AS n_tokens FROM documents")
def tokenize_distinct_count(spark, sf_dir):
    return sparse.tokenised(table(spark, sf_dir, "documents")).select("doc_id", F.col("doc_len").alias("n_tokens"))


@query(f"SELECT word, array_to_string(list_transform(regexp_extract_all(word, '[A-Za-z0-9]+'), lambda w: array_to_string({_SUBWORDS.format(parts=_PARTS.format(w='w'), w='w')}, ' ')), '|') AS parts FROM {values([(w,) for w in WORDS], 'word')}")
def tokenize_camel(spark, sf_dir):
    per_word = F.transform(T.words(F.col("word")), lambda w: F.array_join(T._subwords(w), " "))
    return literal(spark, [(w,) for w in WORDS], "word").select("word", F.array_join(per_word, "|").alias("parts"))


@query("SELECT doc_id, CAST(greatest(1, length(coalesce(text, '')) // 4) AS BIGINT) AS est_tokens FROM documents")
def est_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.coalesce("text", F.lit(""))).alias("est_tokens"))


@query(f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9]+')) >= {chunking.LEAST_FILE}")
def min_size_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.size(T.words(F.col("text"))) >= chunking.LEAST_FILE).select("doc_id")


@query(f"WITH {_TOKENISED} SELECT term, count(*) AS df FROM terms GROUP BY term ORDER BY df DESC, term LIMIT 100")
def doc_freq_top(spark, sf_dir):
    return sparse.document_frequency(sparse.tokenised(table(spark, sf_dir, "documents"))).orderBy(F.desc("df"), "term").limit(100)


@query(f"WITH {_TOKENISED}, {_STATS} SELECT n_docs, total_len, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, sf_dir):
    return sparse.corpus_stats(sparse.tokenised(table(spark, sf_dir, "documents"))).select("n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_TOKENISED}, {_STATS}, {_IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf_floor(spark, sf_dir):
    tokenised = sparse.tokenised(table(spark, sf_dir, "documents"))
    return sparse.idf(sparse.document_frequency(tokenised), sparse.corpus_stats(tokenised)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(_BM25 + f"SELECT doc_id, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {K}")
def bm25_topk(spark, sf_dir):
    return sparse.top(sparse.scores(sparse.tokenised(table(spark, sf_dir, "documents")), QUERY), K)


@query(_BM25 + "SELECT doc_id, score FROM scored")
def bm25_scores(spark, sf_dir):
    return sparse.scores(sparse.tokenised(table(spark, sf_dir, "documents")), QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query(_BM25.replace("FROM documents)", "FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1))", 1) + f"SELECT doc_id, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {K}")
def bm25_after_removal(spark, sf_dir):
    removed = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    left = sparse.without(table(spark, sf_dir, "documents"), removed)
    return sparse.top(sparse.scores(sparse.tokenised(left), QUERY), K)


_D2 = "round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9)"
_NEAR = f"near AS (SELECT v.vec_id, {_D2} AS d2 FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY d2, vec_id LIMIT "


def _vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


@query(f"WITH {_NEAR}{K}) SELECT * FROM near")
def knn_l2_topk(spark, sf_dir):
    return dense.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), K)


@query(
    f"SELECT qid, vec_id, round(d2, 6) AS d2, rank FROM (SELECT q.vec_id AS qid, v.vec_id, {_D2} AS d2, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_D2}, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5"
)
def knn_batch(spark, sf_dir):
    """Every row whose vec_id is divisible by 50 asks, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    found = dense.nearest_to_all(vectors, vectors.where("vec_id % 50 = 0"), 5)
    return found.select("qid", "vec_id", F.round("d2", 6).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH {_TOKENISED}, {_STATS}, {_IDF}, {_SCORES}, {_NEAR}{fusion.DEPTH * K}), "
    "dr AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY d2, vec_id) - 1 AS dense_rank FROM near), "
    f"st AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {fusion.DEPTH * K}), "
    "sr AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS sparse_rank FROM st), "
    "both_ AS (SELECT coalesce(dr.doc_id, sr.doc_id) AS doc_id, dense_rank, sparse_rank FROM dr FULL OUTER JOIN sr ON dr.doc_id = sr.doc_id) "
    "SELECT doc_id, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank + 1), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank + 1), 0), 9) AS fusion_score "
    f"FROM both_ ORDER BY fusion_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id LIMIT {K}"
)
def rrf_hybrid_topk(spark, sf_dir):
    """Dense ranks are those of vectors with the documents' numbers: the tables are synthetic and unrelated."""
    depth = fusion.DEPTH * K
    near = dense.nearest(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), depth).withColumnRenamed("vec_id", "doc_id")
    match = sparse.top(sparse.scores(sparse.tokenised(table(spark, sf_dir, "documents")), QUERY), depth)
    return fusion.fused(fusion.ranked(near, "doc_id", "d2", "doc_id"), fusion.ranked(match, "doc_id", F.desc("score"), F.col("doc_id")), K)


_LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line_text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)"


@query(
    f"WITH {_LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, byte_start, byte_start + strlen(line_text) AS byte_end FROM "
    "(SELECT *, CAST(coalesce(sum(strlen(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM lines)"
)
def line_byte_ranges(spark, sf_dir):
    return chunking.line_ranges(table(spark, sf_dir, "documents"))


@query(
    f"WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(0, len(ws), {WINDOW - OVERLAP})) AS a FROM w) "
    f"SELECT doc_id, CAST(a // {WINDOW - OVERLAP} AS INTEGER) AS chunk_id, CAST(a AS INTEGER) AS token_start, CAST(len(ws[a + 1:a + {WINDOW}]) AS INTEGER) AS n_tokens, md5(array_to_string(ws[a + 1:a + {WINDOW}], ' ')) AS chunk_md5 FROM s"
)
def fixed_window_chunks(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    return chunking.fixed_windows(words, "doc_id", "w", WINDOW, OVERLAP).withColumn("chunk_md5", F.md5("chunk_text")).drop("chunk_text")


_SCOPE_COLUMNS = "path, name, kind, start_line, end_line, ordinal"
_DEEPEST = (
    f"f AS (SELECT path, unnest(range(1, n_lines + 1)) AS line FROM {values(FILE_LINES, 'path, n_lines')}), s AS (SELECT * FROM {values(SCOPES, _SCOPE_COLUMNS)}), "
    "deepest AS (SELECT f.path, f.line, s.name, s.kind, s.ordinal, row_number() OVER (PARTITION BY f.path, f.line ORDER BY s.end_line - s.start_line, s.ordinal DESC) AS r FROM f LEFT JOIN s ON f.path = s.path AND f.line BETWEEN s.start_line AND s.end_line)"
)


def _deepest(spark) -> DataFrame:
    return chunking.deepest_scopes(literal(spark, SCOPES, _SCOPE_COLUMNS), literal(spark, FILE_LINES, "path, n_lines"))


@query(f"WITH {_DEEPEST} SELECT path, CAST(line AS INTEGER) AS line, name, kind FROM deepest WHERE r = 1")
def deepest_scope(spark, sf_dir):
    return _deepest(spark).select("path", "line", "name", "kind")


@query(
    f"WITH {_DEEPEST}, marked AS (SELECT *, CASE WHEN lag(line) OVER w IS NOT NULL AND lag(ordinal) OVER w IS NOT DISTINCT FROM ordinal THEN 0 ELSE 1 END AS new FROM deepest WHERE r = 1 WINDOW w AS (PARTITION BY path ORDER BY line)), "
    "cut AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line) AS island FROM marked) "
    "SELECT path, CAST(island - 1 AS INTEGER) AS island, coalesce(any_value(name), 'Global') AS scope_name, coalesce(any_value(kind), 'global') AS scope_type, CAST(min(line) AS INTEGER) AS start_line, CAST(max(line) AS INTEGER) AS end_line FROM cut GROUP BY path, island"
)
def scope_islands(spark, sf_dir):
    return chunking.islands(_deepest(spark)).drop("ordinal")


@query("SELECT doc_id, md5(unhex(substr(hex(encode(coalesce(text, ''))), 201, 400))) AS splice_md5 FROM documents")
def splice_bytes(spark, sf_dir):
    """Bytes 100 to 300 of every text, cut characters and all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return docs.select("doc_id", F.md5(T.cut(F.col("content"), F.lit(100), F.lit(300))).alias("splice_md5"))


@query()
def splice_bytes_all(spark, sf_dir):
    """The same as text, where cut characters are replaced; SQL has no such decoding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return docs.select("doc_id", F.md5(T.spliced(F.col("content"), F.lit(100), F.lit(300))).alias("splice_md5"))


_HREFS = "hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS ordinal FROM pages), clean AS (SELECT page_id, ordinal, regexp_replace(regexp_replace(raw, '[?#].*$', ''), '^([a-z]+://)?/*', '') AS target FROM hrefs)"


def _links(spark, sf_dir) -> DataFrame:
    hrefs = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ordinal", "raw"))
    target = F.regexp_replace(F.regexp_replace("raw", "[?#].*$", ""), "^([a-z]+://)?/*", "")
    return hrefs.select("page_id", target.alias("target"), "ordinal").groupBy("page_id", "target").agg(F.min("ordinal").alias("ordinal"))


@query(f"WITH {_HREFS} SELECT page_id, target, CAST(min(ordinal) AS INTEGER) AS ordinal FROM clean GROUP BY page_id, target")
def link_edges(spark, sf_dir):
    return _links(spark, sf_dir)


@query(f"WITH {_HREFS} SELECT DISTINCT target AS dst, page_id AS src FROM clean")
def links_reverse(spark, sf_dir):
    return graph.reversed_links(_links(spark, sf_dir).select(F.col("page_id").alias("src"), F.col("target").alias("dst")))


@query(f"WITH {_HREFS} SELECT target, count(DISTINCT page_id) AS n_pages FROM clean GROUP BY target")
def links_counted(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n_pages"))


@query(
    f"WITH c AS (SELECT * FROM {values(CALLS, 'path, scope, callee')}), l AS (SELECT * FROM {values(LINKS, 'src, dst, ordinal')}), s AS (SELECT * FROM {values(SYMBOLS, 'path, name, kind, owner, args, docstring, ordinal')}), "
    "scopes AS (SELECT DISTINCT path, path AS target, -1 AS near FROM c UNION ALL SELECT src, dst, ordinal FROM l) "
    "SELECT path, scope, callee, target, kind, owner, args, docstring FROM (SELECT c.path, c.scope, c.callee, scopes.target, s.kind, s.owner, s.args, s.docstring, row_number() OVER (PARTITION BY c.path, c.scope, c.callee ORDER BY near, s.kind, s.ordinal) AS r "
    "FROM c JOIN scopes ON c.path = scopes.path JOIN s ON s.path = scopes.target AND s.name = c.callee) WHERE r = 1"
)
def call_resolution(spark, sf_dir):
    return graph.resolved_calls(literal(spark, CALLS, "path, scope, callee"), literal(spark, SYMBOLS, "path, name, kind, owner, args, docstring, ordinal"), literal(spark, LINKS, "src, dst, ordinal"))


_PAGE_PATHS = "p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages)"


@query(
    f"WITH {_PAGE_PATHS}, q AS (SELECT path AS asked FROM p UNION SELECT replace(regexp_extract(path, '[^/]+/[^/]+$'), '/', chr(92)) FROM p WHERE path LIKE '%/%/%') "
    "SELECT asked, min_by(path, rank * 1000000 + pos) AS path FROM (SELECT asked, path, CASE WHEN path = replace(asked, chr(92), '/') THEN 0 ELSE 1 END AS rank, row_number() OVER (PARTITION BY asked ORDER BY path) AS pos FROM q JOIN p ON path = replace(asked, chr(92), '/') OR ends_with(path, '/' || replace(asked, chr(92), '/'))) GROUP BY asked"
)
def path_resolve(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    known = table(spark, sf_dir, "pages").select(path.alias("path")).distinct()
    tails = known.where(F.col("path").like("%/%/%")).select(F.replace(F.regexp_extract("path", "[^/]+/[^/]+$", 0), F.lit("/"), F.lit("\\")).alias("asked"))
    asked = known.select(F.col("path").alias("asked")).unionByName(tails).distinct()
    return graph.resolved_paths(asked, known)


@query("SELECT md5(text) AS md5, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def content_md5_dupes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(T.content_hash(F.col("text")).alias("md5")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR before IS DISTINCT FROM event_type")
def hash_change_events(spark, sf_dir):
    return versions.changes(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "event_type")


@query(
    f"WITH RECURSIVE t AS (SELECT user_id, epoch_us(ts) AS us FROM events), b AS (SELECT user_id, min(us) AS start, CAST(0 AS BIGINT) AS batch FROM t GROUP BY user_id UNION ALL "
    f"SELECT b.user_id, min(t.us), b.batch + 1 FROM b JOIN t ON t.user_id = b.user_id AND t.us >= b.start + {DEBOUNCE_SECONDS * 1_000_000} GROUP BY b.user_id, b.batch) "
    f"SELECT b.user_id, b.batch, b.start AS batch_start_us, count(*) AS n FROM b JOIN t ON t.user_id = b.user_id AND t.us >= b.start AND t.us < b.start + {DEBOUNCE_SECONDS * 1_000_000} GROUP BY ALL"
)
def debounce_batches(spark, sf_dir):
    return versions.debounced(table(spark, sf_dir, "events"), "user_id", "ts", DEBOUNCE_SECONDS)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_version(spark, sf_dir):
    return versions.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query(
    "SELECT user_id, dead, total, dead > 50 OR (total > 0 AND dead > 0.2::DOUBLE * total) AS compact FROM (SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS dead, count(*) AS total FROM events GROUP BY user_id)"
)
def gc_trigger(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("dead"), F.count("*").alias("total"))
    return counted.select("user_id", "dead", "total", versions.needs_compaction(F.col("dead"), F.col("total")).alias("compact"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(line AS INTEGER) AS line, md5(lpad(CAST(line AS VARCHAR), CAST(greatest(4, length(CAST(line AS VARCHAR))) AS INTEGER), ' ') || ': ' || line_text) AS numbered_md5 FROM lines")
def numbered_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line_text"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line"), F.md5(T.numbered(F.col("i") + 1, F.col("line_text"))).alias("numbered_md5"))


@query(
    f"WITH s AS (SELECT * FROM {values(SCOPES, _SCOPE_COLUMNS)}), f AS (SELECT path FROM {values([*FILE_LINES, ('d.txt', 1)], 'path, n_lines')}), "
    "g AS (SELECT path, string_agg(name, ', ' ORDER BY ordinal) FILTER (WHERE kind = 'class') AS c, string_agg(name, ', ' ORDER BY ordinal) FILTER (WHERE kind = 'function') AS fn FROM s GROUP BY path) "
    f"SELECT f.path, coalesce(nullif(concat_ws(' | ', 'Classes: ' || c, 'Functions: ' || fn), ''), '{symbols.NO_SYMBOLS}') AS summary FROM f LEFT JOIN g ON f.path = g.path"
)
def file_summary(spark, sf_dir):
    return symbols.summaries(literal(spark, [*FILE_LINES, ("d.txt", 1)], "path, n_lines"), literal(spark, SCOPES, _SCOPE_COLUMNS))


def as_files(spark, rows: list[tuple[str, str]]) -> DataFrame:
    """Rows of FILES from paths and texts."""
    files = spark.createDataFrame([(p, c.encode()) for p, c in rows], "path string, content binary")
    sized = files.withColumn("ext", T.suffix(F.col("path"))).withColumn("size", F.octet_length("content").cast("long"))
    return sized.select("path", "ext", "content", "size", F.md5("content").alias("md5"), F.lit(0).cast("long").alias("mtime"))


def source_files(spark) -> DataFrame:
    return as_files(spark, SOURCE_FILES)


@query(f"SELECT src, dst FROM {values(IMPORT_EDGES, 'src, dst')}")
def import_edges(spark, sf_dir):
    files = source_files(spark)
    return graph.edges(files, graph.imports(files)).select("src", "dst")


@query(f"WITH e AS (SELECT * FROM {values(IMPORT_EDGES, 'src, dst')}) SELECT dst AS path, string_agg(src, ',' ORDER BY src) AS imported_by FROM e GROUP BY dst")
def imported_by(spark, sf_dir):
    files = source_files(spark)
    near = graph.neighbours(files, graph.edges(files, graph.imports(files)))
    return near.where(F.size("imported_by") > 0).select("path", F.array_join("imported_by", ",").alias("imported_by"))


@query("SELECT url, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix, name FROM (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS name FROM pages)")
def path_parts(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url")).distinct()
    return urls.select("url", T.suffix(F.col("url")).alias("suffix"), T.file_name(F.col("url")).alias("name"))


@query("SELECT count(*) AS live, CAST(sum(turns) AS BIGINT) AS turns FROM (SELECT conv_id, count(*) AS turns FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id AND d.lang <> 'en') GROUP BY conv_id)")
def live_rows(spark, sf_dir):
    dead = table(spark, sf_dir, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("conv_id"))
    live = table(spark, sf_dir, "conversations").join(dead, "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return live.agg(F.count("*").alias("live"), F.sum("turns").alias("turns"))


RAW_IMPORTS = ["'./lib/tools'", '"../../a/b.js"', "react", " java.util.List ", "../x", "..", "'quoted'", "a.b.c"]


@query(f"SELECT raw, regexp_replace(trim(trim(trim(trim(raw), chr(39)), chr(34))), '^[./]+', '') AS clean FROM {values([(r,) for r in RAW_IMPORTS], 'raw')}")
def clean_imports(spark, sf_dir):
    return literal(spark, [(r,) for r in RAW_IMPORTS], "raw").select("raw", T.cleaned_import(F.col("raw")).alias("clean"))


@query("SELECT url, CAST(row_number() OVER (ORDER BY url) - 1 AS BIGINT) AS file_idx FROM (SELECT DISTINCT url FROM pages)")
def path_dictionary(spark, sf_dir):
    return versions.numbered(table(spark, sf_dir, "pages").select("url").distinct(), "url", "file_idx")


@query(f"SELECT vec_id, {_D2} AS d2 FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.label <> (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY d2, vec_id LIMIT {K}")
def knn_live_topk(spark, sf_dir):
    """Deleted rows go before the ranking, so that k rows are left of it."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").first()
    return dense.nearest(vectors.where(F.col("label") != asked.label), list(asked.embedding), K)


@query()
def structure_chunks(spark, sf_dir):
    files = source_files(spark)
    found = symbols.symbols(files)
    return index.chunked(files, found, graph.edges(files, graph.imports(files)), WordTokenizer(), least=1)


@query()
def symbol_table(spark, sf_dir):
    return symbols.symbols(source_files(spark))


def _stored_bm25(spark, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, term frequencies and totals, written to a store and read back."""
    store = SnapshotStore(spark, scratch(spark), key="doc_id")
    tokenised = store.stage("tokens", 1, sparse.tokenised(docs))
    postings = store.stage("postings", 1, sparse.postings(tokenised, "doc_id"), "term", ("term",))
    terms = store.stage("terms", 1, sparse.document_frequency(tokenised), "term", ("term",))
    return postings, terms, sparse.corpus_stats(tokenised.select("doc_len"))


@query(_BM25 + f"SELECT doc_id, score FROM scored WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {K}")
def bm25_stored_topk(spark, sf_dir):
    """The same from stored postings, as an index searches: of postings and terms, the query's alone are read."""
    postings, terms, stats = _stored_bm25(spark, table(spark, sf_dir, "documents"))
    totals = stats.first()
    mean = terms.agg(F.avg(sparse.raw_idf(F.lit(totals.n_docs), F.col("df")))).first()[0]
    known = {r.term: r.df for r in terms.where(F.col("term").isin(QUERY)).collect()}
    hits = postings.where(F.col("term").isin(QUERY))
    return sparse.top(sparse.scored(hits, sparse.floored(known, totals.n_docs, mean), totals.avgdl), K)


FILLER = " ".join(f"word{i}" for i in range(60))
PROJECT = [
    ("core.py", f'"""Core. {FILLER}"""\nimport util\n\n\nclass Engine:\n    def start(self, speed: int):\n        """Starts the turbine."""\n        return util.spinUp(speed)\n\n\ndef stopEverything():\n    return Engine()\n'),
    ("util.py", f'"""Util. {FILLER}"""\n\n\ndef spinUp(speed):\n    """Turns the wheel."""\n    return speed\n'),
    ("notes.md", f"About gardens.\n{FILLER}\n"),
    ("small.py", "x = 1\n"),
]
CHANGED = [("util.py", PROJECT[1][1].replace("spinUp", "spinDown")), ("fresh.py", f"# {FILLER}\nimport util\n\n\ndef brandNew():\n    return util.spinDown(1)\n")]


def _project(spark) -> index.Index:
    store = index.Index(spark, scratch(spark))
    store.replace(as_files(spark, PROJECT))
    return store


@query(f"SELECT * FROM {values([(4, 4, 1, 7)], 'n_files, n_symbols, n_edges, n_chunks')}")
def index_build_stats(spark, sf_dir):
    """Files, symbols, edges and chunks of a built index."""
    got = _project(spark).stats().select("n_files", "n_symbols", "n_edges", F.col("n_docs").alias("n_chunks"))
    return got.select(*[F.col(c).cast("int").alias(c) for c in got.columns])


@query(f"SELECT * FROM {values([('turbine', 'core.py', 2), ('gardens', 'notes.md', 0), ('wheel spin', 'util.py', 1)], 'asked, path, chunk_id')}")
def index_search_hits(spark, sf_dir):
    """The best chunk of some questions: both sides, fused, with its file."""
    store, out = _project(spark), None
    for asked in ("turbine", "gardens", "wheel spin"):
        hit = retrieve.search(store, asked, 1).select(F.lit(asked).alias("asked"), "path", "chunk_id")
        out = hit if out is None else out.unionByName(hit)
    return out


@query(f"SELECT * FROM {values([(t, 0) for t in ('chunks', 'edges', 'postings', 'stats', 'summaries', 'symbols', 'terms', 'vectors')], 'name, n_different')}")
def index_update_rebuild(spark, sf_dir):
    """Rows in which an index that was updated differs from one that was built anew: none, in any table."""
    store, fresh = _project(spark), index.Index(spark, scratch(spark))
    store.update(as_files(spark, CHANGED), spark.createDataFrame([("notes.md",)], "path string"))
    fresh.replace(as_files(spark, [*dict([*PROJECT, *CHANGED]).items()]).where("path <> 'notes.md'"))
    out = None
    for name in ("chunks", "edges", "postings", "stats", "summaries", "symbols", "terms", "vectors"):
        x, y = (i.table(name) for i in (store, fresh))
        part = x.exceptAll(y.select(x.columns)).unionByName(y.select(x.columns).exceptAll(x)).agg(F.count("*").cast("int").alias("n_different")).select(F.lit(name).alias("name"), "n_different")
        out = part if out is None else out.unionByName(part)
    return out


DELTAS = [
    ("update", "a.py", "m1", 1), ("update", "a.py", "m0", 2), ("update", "b.py", "m2", 1), ("update", "b.py", "m3", 3), ("delete", "c.py", "", 2), ("delete", "gone.py", "", 2), ("delete", "d.py", "", 1), ("update", "d.py", "m5", 4), ("update", "new.py", "m6", 1), ("delete", "new.py", "", 2),
]
INDEXED = [("a.py", "m0"), ("b.py", "m2"), ("c.py", "m4"), ("d.py", "m5")]


@query(
    f"SELECT action, path, d.md5 FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC) AS r FROM {values(DELTAS, 'action, path, md5, ts')}) d LEFT JOIN (SELECT path, md5 AS known FROM {values(INDEXED, 'path, md5')}) USING (path) "
    "WHERE r = 1 AND CASE WHEN action = 'delete' THEN known IS NOT NULL ELSE d.md5 IS DISTINCT FROM known END"
)
def live_changes(spark, sf_dir):
    """Of a burst of changes the last of each path, if it changes what is indexed."""
    return live.effective(literal(spark, DELTAS, "action, path, md5, ts"), literal(spark, INDEXED, "path, md5")).select("action", "path", "md5")


from . import search_queries, stored_queries, stream_queries  # noqa: E402, F401  they register their queries
