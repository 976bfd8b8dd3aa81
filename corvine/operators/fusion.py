"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAMPING = 60
DEPTH = 4


def ranked(hits: DataFrame, key: str, *order) -> DataFrame:
    """key and its 0-based rank. `hits` is a top-k list, so one window over it is small."""
    return hits.select(key, (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def _shares(dense: DataFrame, sparse: DataFrame, *key: str, digits: int = 9) -> DataFrame:
    """key, both ranks and fusion_score: each list adds 1 / (DAMPING + rank + 1)."""
    both = dense.select(*key, F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank")).unionByName(
        sparse.select(*key, F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"))
    )
    one = both.groupBy(*key).agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    share = lambda c: F.coalesce(1.0 / (DAMPING + F.col(c) + 1), F.lit(0.0))
    return one.withColumn("fusion_score", F.round(share("dense_rank") + share("sparse_rank"), digits))


def _best_first(key: str) -> tuple:
    """Ties: dense ranks first, then sparse."""
    return F.desc("fusion_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.col(key)


def fused(dense: DataFrame, sparse: DataFrame, k: int, key: str = "doc_id", digits: int = 9) -> DataFrame:
    """key, fusion_score and both ranks of the k best."""
    return _shares(dense, sparse, key, digits=digits).orderBy(*_best_first(key)).limit(k)


def fused_each(dense: DataFrame, sparse: DataFrame, k: int, key: str = "doc_id", query: str = "qid") -> DataFrame:
    """The same for each query: query, key, both ranks, fusion_score and rank (from 1)."""
    order = Window.partitionBy(query).orderBy(*_best_first(key))
    return _shares(dense, sparse, query, key).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
