"""BM25 over sub-word tokens: statistics, floored IDF, postings, scores and top-k.

A document is a set of tokens, so each term frequency is 1 and the length is the number of tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75
#: Terms in more than half of the documents get this share of the mean IDF.
FLOOR = 0.25


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens and doc_len."""
    return docs.select(key, tokens(F.col(text)).alias("tokens")).withColumn("doc_len", F.size("tokens").cast("long"))


def document_frequency(tokenised: DataFrame) -> DataFrame:
    """term and df; counts are combined before the shuffle."""
    return tokenised.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(tokenised: DataFrame, *columns: str) -> DataFrame:
    """term, the given columns and doc_len: a row for each term of each document."""
    return tokenised.select(F.explode("tokens").alias("term"), *columns, "doc_len")


def corpus_stats(tokenised: DataFrame) -> DataFrame:
    """One row: n_docs, total_len and avgdl."""
    total = F.coalesce(F.sum("doc_len"), F.lit(0))
    return tokenised.agg(F.count("*").alias("n_docs"), total.alias("total_len"), (total / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def raw_idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.greatest(F.lit(0.5), n_docs - df + 0.5)) - F.log(F.greatest(F.lit(0.5), df + 0.5))


def idf(df: DataFrame, stats: DataFrame, *keep: str) -> DataFrame:
    """term, df, the columns of `keep` and idf: negative ones become FLOOR of the mean over the whole vocabulary, itself negative or not."""
    raw = df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", *keep, raw_idf(F.col("n_docs"), F.col("df")).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", *keep, F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def floored(df: dict[str, int], n_docs: int, mean: float | None) -> dict[str, float]:
    """The same IDF of a few terms, from stored statistics: mean is the vocabulary's raw one."""
    raw = {t: math.log(max(0.5, n_docs - n + 0.5)) - math.log(max(0.5, n + 0.5)) for t, n in df.items()}
    return {t: FLOOR * mean if x < 0 else x for t, x in raw.items()}


def weight(doc_len: Column, avgdl: Column) -> Column:
    """What an IDF is multiplied by where its term occurs."""
    norm = F.when(avgdl > 0, K1 * (1 - B + B * doc_len / avgdl)).otherwise(F.lit(1.0))
    return (K1 + 1) / (1 + norm)


def scored(hits: DataFrame, weights: dict[str, float], avgdl: float, key: str = "doc_id") -> DataFrame:
    """key and score from some terms' postings (key, term, doc_len) and their IDF."""
    if not weights:
        return hits.limit(0).select(key, F.lit(0.0).alias("score"))
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    weighed = hits.where(F.col("term").isin(list(weights))).select(key, (known[F.col("term")] * weight(F.col("doc_len"), F.lit(float(avgdl)))).alias("w"))
    return weighed.groupBy(key).agg(F.sum("w").alias("score"))


def scores(tokenised: DataFrame, query: list[str], key: str = "doc_id") -> DataFrame:
    """key and score of the documents that share a term with the query, without stored statistics.

    Texts are read twice: once for the vocabulary's document frequencies, which also add up to the total
    length, once for what is scored. Of the former one row is left, with the query's IDFs, and is broadcast;
    terms that no document has are skipped.
    """
    asked = list(dict.fromkeys(query)) or [""]
    n_docs = tokenised.agg(F.count("*").alias("n_docs"))
    raw = document_frequency(tokenised).crossJoin(F.broadcast(n_docs)).withColumn("raw", raw_idf(F.col("n_docs"), F.col("df")))
    own = [F.max(F.when(F.col("term") == t, F.col("raw"))).alias(f"raw_{i}") for i, t in enumerate(asked)]
    totals = raw.agg((F.sum("df") / F.max("n_docs")).alias("avgdl"), F.avg("raw").alias("mean"), *own)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"raw_{i}").alias("raw")) for i, t in enumerate(asked)]))
    wanted = totals.select("avgdl", "mean", each.alias("t")).where("t.raw is not null")
    wanted = wanted.select("t.term", "avgdl", F.when(F.col("t.raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("t.raw")).alias("idf"))
    hits = tokenised.select(key, "doc_len", F.explode(F.array_intersect("tokens", F.array(*map(F.lit, asked)))).alias("term"))
    weighed = hits.join(F.broadcast(wanted), "term")
    return weighed.groupBy(key).agg(F.sum(F.col("idf") * weight(F.col("doc_len"), F.col("avgdl"))).alias("score"))


def top(scored: DataFrame, k: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """The k best positive scores, ties by key. Scores are rounded first, so that the cut doesn't hang on the order of a sum."""
    return scored.select(key, F.round("score", digits).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def without(tokenised: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The corpus without some documents; statistics are taken from what is left, so removing twice is removing once."""
    return tokenised.join(removed.select(key), key, "left_anti")
