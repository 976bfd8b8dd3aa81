"""Registered queries over stored forms of given tables: snapshots, blocks of texts, elements of pages; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import intervals
from .plans.snapshots import Snapshot, changes
from .plans.text_blocks import TextBlocks
from .queries import query, table

#: Elements of a page that tell where a link stands.
PLACES = ("html", "head", "body", "nav", "ul", "li", "div", "article", "footer")

_EDITED = (
    "edited AS (SELECT doc_id, CASE WHEN doc_id % 1000 BETWEEN 20 AND 29 THEN coalesce(text, '') || ' edited' ELSE text END AS text, lang, source, n_chars FROM documents WHERE doc_id % 1000 NOT BETWEEN 10 AND 19 "
    "UNION ALL SELECT -1 - doc_id, text, lang, source, n_chars FROM documents WHERE doc_id % 1000 = 7)"
)


@query(
    f"WITH {_EDITED} SELECT coalesce(d.doc_id, e.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN e.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM documents d FULL OUTER JOIN edited e ON d.doc_id = e.doc_id "
    "WHERE d.doc_id IS NULL OR e.doc_id IS NULL OR d.text IS DISTINCT FROM e.text OR d.lang IS DISTINCT FROM e.lang OR d.source IS DISTINCT FROM e.source OR d.n_chars IS DISTINCT FROM e.n_chars"
)
def snapshot_diff(spark, sf_dir):
    """Documents against a copy of which some neighbouring rows were removed, edited and added: only ranges that differ are read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    at = F.col("doc_id") % 1000
    kept = docs.where(~at.between(10, 19)).withColumn("text", F.when(at.between(20, 29), F.concat(F.coalesce("text", F.lit("")), F.lit(" edited"))).otherwise(F.col("text")))
    edited = kept.unionByName(docs.where(at == 7).withColumn("doc_id", -1 - F.col("doc_id")))
    return changes(Snapshot.build(docs, "doc_id"), Snapshot.build(edited, "doc_id"))[0]


_BLOB = "hex(encode(coalesce(d.text, '')))"
_RANGES = "(SELECT page_id, (page_id * 7919) % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, (page_id * 31) % 3000 AS s, (page_id * 31) % 3000 + 1 + page_id % 500 AS e FROM pages WHERE page_id % 10 = 0) r"


@query(f"SELECT r.page_id, r.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, md5(unhex(x)) AS md5 FROM (SELECT r.page_id, r.doc_id, coalesce(substr({_BLOB}, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)), '') AS x FROM {_RANGES} LEFT JOIN documents d ON d.doc_id = r.doc_id) r")
def splice_blocks(spark, sf_dir):
    """Byte ranges that a second table asks for, from stored blocks of the documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").where("page_id % 10 = 0")
    n = docs.agg(F.max("doc_id") + 1).first()[0]
    start = (F.col("page_id") * 31) % 3000
    ranges = pages.select(F.col("page_id").alias("id"), ((F.col("page_id") * 7919) % n).alias("key"), start.alias("start"), (start + 1 + F.col("page_id") % 500).alias("end"))
    found = TextBlocks.build(docs).splice(ranges)
    return found.select(F.col("id").alias("page_id"), F.col("key").alias("doc_id"), F.octet_length("bytes").cast("long").alias("n_bytes"), F.md5("bytes").alias("md5"))


_IN = ", ".join(f"'{p}'" for p in PLACES)
_PIECES = (
    "cut AS (SELECT page_id, length(coalesce(html, '')) AS length, unnest(string_split(coalesce(html, ''), '<')) AS piece, generate_subscripts(string_split(coalesce(html, ''), '<'), 1) AS i FROM pages), "
    "pieces AS (SELECT page_id, length, piece, i, CAST(sum(length(piece) + 1) OVER (PARTITION BY page_id ORDER BY i) - length(piece) - 2 AS BIGINT) AS pos FROM cut), "
    "tags AS (SELECT page_id, length, pos, lower(regexp_extract(piece, '^(/?)([A-Za-z][A-Za-z0-9]*)', 2)) AS name, starts_with(piece, '/') AS closing FROM pieces WHERE i > 1 AND regexp_matches(piece, '^/?[A-Za-z]')), "
)


@query(
    f"WITH {_PIECES} level AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY pos ROWS UNBOUNDED PRECEDING) + CASE WHEN closing THEN 1 ELSE 0 END AS level FROM tags WHERE name IN ({_IN})), "
    "paired AS (SELECT *, lead(pos) OVER w AS next, lead(closing) OVER w AS closes FROM level WINDOW w AS (PARTITION BY page_id, name, level ORDER BY pos)), "
    "elements AS (SELECT page_id, name, pos AS start, CASE WHEN closes THEN next ELSE length END AS end_ FROM paired WHERE NOT closing), "
    "links AS (SELECT page_id, pos FROM tags WHERE name = 'a' AND NOT closing) "
    "SELECT l.page_id, l.pos, e.name, e.start FROM links l LEFT JOIN elements e ON e.page_id = l.page_id AND e.start <= l.pos AND l.pos < e.end_ QUALIFY row_number() OVER (PARTITION BY l.page_id, l.pos ORDER BY e.end_ - e.start, e.start DESC) = 1"
)
def link_places(spark, sf_dir):
    """Of each link of the pages the innermost element that it stands in."""
    tagged = intervals.tags(table(spark, sf_dir, "pages"), "page_id", "html", "a", *PLACES)
    inside = intervals.elements(tagged.where("name <> 'a'"), "page_id")
    links = tagged.where("name = 'a' and not closing").select("page_id", "at")
    return intervals.stabbed(inside, links, "page_id", "name").select("page_id", F.col("at").alias("pos"), "name", F.col("ordinal").alias("start"))
