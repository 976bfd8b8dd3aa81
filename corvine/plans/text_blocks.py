"""Texts in stored blocks, so that a byte range reads the blocks it meets and no more.

A text's bytes are cut every SIZE; a block is a row of (key, block, bytes), in folders by a hash of both, and
sorted within. Ranges that ask for few folders or keys push them to the scan as lists, so Parquet skips what
no range needs; any number of ranges joins the blocks by key and number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import scratch

SIZE, FOLDERS, PUSHED = 4096, 64, 1_000


def _folder():
    """By key and block, so that the blocks of one long text lie in many folders."""
    return F.pmod(F.xxhash64("key", "block"), F.lit(FOLDERS)).cast("int")


class TextBlocks:
    """<folder>/blocks/folder=<n> (key, block, bytes) and <folder>/sizes (key, size). Keys are unique; a null text has no bytes."""

    def __init__(self, spark: SparkSession, folder: str, size: int = SIZE):
        self.spark, self.folder, self.size = spark, folder.rstrip("/"), size

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, size: int = SIZE) -> TextBlocks:
        out = cls(docs.sparkSession, folder or scratch(docs.sparkSession), size)
        content = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("bytes"))
        content.select("key", F.octet_length("bytes").cast("long").alias("size")).write.mode("overwrite").parquet(f"{out.folder}/sizes")
        n = F.ceil(F.octet_length("bytes") / size).cast("int")
        cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("bytes", (i - 1) * size + 1, F.lit(size)))
        blocks = content.where(n > 0).select("key", F.posexplode(cut).alias("block", "bytes")).withColumn("folder", _folder())
        blocks.repartition("folder").sortWithinPartitions("folder", "key", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{out.folder}/blocks")
        return out

    def needed(self, ranges: DataFrame) -> DataFrame:
        """Of ranges (id, key, start, end): id, key, low, high (clamped to the text) and a row for each block met; a range without bytes has one row and a null block."""
        sizes = self.spark.read.parquet(f"{self.folder}/sizes")
        clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.coalesce("size", F.lit(0))).cast("long")
        clamped = ranges.join(sizes, "key", "left").select("id", "key", clamp("start").alias("low"), clamp("end").alias("high"))
        met = F.when(F.col("low") < F.col("high"), F.sequence(F.floor(F.col("low") / self.size).cast("int"), F.floor((F.col("high") - 1) / self.size).cast("int")))
        return clamped.select("id", "key", "low", "high", F.explode_outer(met).alias("block"))

    def blocks(self, wanted: DataFrame) -> DataFrame:
        """The stored blocks, less what `wanted` (key, block) can't ask for where that is few."""
        stored = self.spark.read.parquet(f"{self.folder}/blocks")
        asked = wanted.where("block is not null").select("key", "block").distinct()
        few = asked.select("key", _folder().alias("folder")).distinct().limit(PUSHED + 1).collect()
        if len(few) <= PUSHED:
            stored = stored.where(F.col("folder").isin(sorted({r.folder for r in few})) & F.col("key").isin(sorted({r.key for r in few})))
        return stored

    def splice(self, ranges: DataFrame) -> DataFrame:
        """id, key and bytes of each range (id, key, start, end), clamped to its text; none of an unknown key is empty."""
        wanted = self.needed(ranges)
        met = wanted.join(self.blocks(wanted), ["key", "block"], "left")
        own = F.col("block").cast("long") * self.size
        part = F.substring("bytes", (F.greatest(F.col("low") - own, F.lit(0)) + 1).cast("int"), (F.least(F.col("high") - own, F.lit(self.size)) - F.greatest(F.col("low") - own, F.lit(0))).cast("int"))
        parts = met.select("id", "key", F.struct("block", F.coalesce(part, F.lit(b"")).alias("bytes")).alias("p")).groupBy("id", "key").agg(F.array_sort(F.collect_list("p")).alias("p"))
        return parts.select("id", "key", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x.bytes)).alias("bytes"))
