"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A normalised text is cut into blocks of BLOCK characters. Distinct blocks are sorted within hash
partitions and numbered there, which names each by an integer that depends on nothing but the set
of blocks; then adjacent pairs of names are sorted and named in the same way, level by level, until
one name is left of each document. Texts are equal exactly if their numbers of blocks and their last
names are: names stand for contents one to one, so there are no collisions to fear.

Texts cross the network once, as distinct blocks, combined before the shuffle. Rows find the name of
their block by a 64-bit routing hash; blocks that share one with another block are named and found
by their content instead. Everything after that works on integers. A group of copies, however
large, is combined before each shuffle that names, and the joins that hand out names are plain equi
joins, whose hot keys adaptive execution splits. There are log2(longest text / BLOCK) levels.

Cases: null counts as the empty text, which is one (empty) block; rows that repeat doc_id and text
are copies of each other, and all of them are returned, as kept if the group's largest doc_id is
theirs; a null doc_id is smaller than any other; an empty table gives an empty result; other
columns of `documents`, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, is_void, lower_az, table, width

BLOCK = 4096
#: A name is its partition's number in these high bits and a rank within the partition below.
SPREAD = 33


def normalised(text):
    return lower_az(F.coalesce(text, F.lit("")))


def name_sorted(distinct: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Names for the rows of `distinct`: they are dealt out by keys, sorted, and numbered in place."""
    return distinct.repartition(n, *keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null, the right side's keys dropped."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_{k}" for k in keys])


def name_documents(docs: DataFrame, block: int = BLOCK, route_bits: int = 64) -> DataFrame:
    """For each row: doc_id, text_sha256, n_blocks and name; equal (n_blocks, name) means equal normalised text.

    route_bits narrows the routing hash, for tests of what happens when blocks share one.
    """
    n = width(docs.sparkSession)
    route = "xxhash64(b)" if route_bits >= 64 else f"pmod(xxhash64(b), {1 << route_bits}L)"
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), normalised(F.col("text")).alias("norm"))
    cut = texts.withColumn("blocks", F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.expr(f"regexp_extract_all(norm, '(?s).{{1,{block}}}', 0)")))
    known = durable(cut.select("doc_id", "text_hash", F.sha2("norm", 256).alias("text_sha256"), F.expr(f"transform(blocks, b -> {route})").alias("routes")))
    blocks = cut.select(F.explode("blocks").alias("b")).select("b", F.expr(route).alias("route"))

    distinct = blocks.groupBy("route", "b").agg(F.max(F.lit(0)).alias("_"))
    names = durable(distinct.sortWithinPartitions("route", "b").select("route", F.monotonically_increasing_id().alias("name")))
    shared = durable(names.groupBy("route").agg(F.count("*").alias("n")).where("n > 1").select("route"))
    places = known.select("doc_id", "text_hash", F.size("routes").alias("n_blocks"), F.posexplode("routes").alias("pos", "route"))
    keys = ["doc_id", "text_hash", "n_blocks", "pos", "name"]
    if is_void(shared):
        level = places.join(names, "route").select(keys)
    else:
        told = durable(name_sorted(blocks.join(shared, "route", "left_semi").distinct(), ["route", "b"], n))
        by_content = cut.select("doc_id", "text_hash", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "b")).withColumn("route", F.expr(route))
        by_content = by_content.join(told.withColumn("name", -1 - F.col("name")), ["route", "b"]).select(keys)
        level = places.join(names.join(shared, "route", "left_anti"), "route").select(keys).unionByName(by_content)
    level = durable(level)

    ends, at = [level.where("n_blocks = 1")], 1
    level = level.where("n_blocks > 1")
    while not is_void(level):
        name = [F.max(F.when(F.col("pos").bitwiseAND(1) == i, F.col("name"))).alias(k) for i, k in enumerate("ab")]
        pairs = durable(level.groupBy("doc_id", "text_hash", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(*name))
        both = pairs.where("b is not null")
        named = name_sorted(both.groupBy("a", "b").agg(F.max(F.lit(0)).alias("_")), ["a", "b"], n).select("a", "b", "name")
        # A last name without a neighbour goes up as it is: documents are compared at equal n_blocks only, where it comes from the same place.
        level = durable(both.join(named, ["a", "b"]).select(keys).unionByName(pairs.where("b is null").withColumnRenamed("a", "name").select(keys)))
        at *= 2
        ends.append(level.where(F.col("n_blocks") <= at))
        level = level.where(F.col("n_blocks") > at)
    done = ends[0]
    for e in ends[1:]:
        done = done.unionByName(e)
    identity = done.groupBy("doc_id", "text_hash", "n_blocks").agg(F.max("name").alias("name"))
    return _same(known.drop("routes"), identity, ["doc_id", "text_hash"]).select("doc_id", "text_sha256", "n_blocks", "name")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, route_bits: int = 64) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, and n_blocks, the number of blocks."""
    named = durable(name_documents(docs, block, route_bits))
    groups = named.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return named.join(groups, ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.col("n_blocks").cast("long").alias("n_blocks"))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256, CAST(greatest(1, ceil(length(t) / 4096.0)) AS BIGINT) AS n_blocks
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
