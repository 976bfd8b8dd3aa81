"""What differs between two snapshots of a table, read only where they differ.

A snapshot lies in folders by range of its keys, and beside it a tree of hashes: a leaf sums up the rows
of a range, a node its FAN children, up to a level of
FAN nodes or fewer. Two trees are compared from the top: only children of nodes that
differ are looked at, and only ranges of leaves that differ are read, on both sides, and joined by key.
Sums don't depend on the order of rows, so a snapshot's tree is the same however it was written.

A range is a whole number given by the caller, or the key divided by SPAN: what is edited together should
lie together. Rows without a key, or without a range, are left out; keys are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import scratch

SPAN, FAN = 64, 16
#: As many leaves, at most, are pushed to the scan as a list of folders.
PUSHED = 10_000


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """n, a and b of each group: how many rows, and two sums of hashes; combined before the shuffle."""
    a = F.expr("coalesce(bit_xor(a), 0L)")
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), a.alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b"))


def _mixed(rows: DataFrame) -> DataFrame:
    """A node as a row of its parent: its sums hashed with its place, so that children can't trade what they hold."""
    b = F.xxhash64(F.lit("b"), "node", "n", "a", "b")
    return rows.select("level", "node", "n", F.xxhash64(F.lit("a"), "node", "n", "a", "b").alias("a"), b.alias("b"))


class Snapshot:
    """<folder>/rows/leaf=<n> and <folder>/tree (level, node, n, a, b); level 0 are the leaves."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    @classmethod
    def build(cls, rows: DataFrame, key: str, folder: str | None = None, place: Column | None = None) -> Snapshot:
        spark = rows.sparkSession
        out = cls(spark, folder or scratch(spark), key)
        leaf = F.floor(F.col(key) / SPAN).cast("long") if place is None else place.cast("long")
        placed = rows.withColumn("leaf", leaf).where(F.col(key).isNotNull() & F.col("leaf").isNotNull())
        # A row is told by its columns and by which of them are null: a hash alone passes nulls over.
        nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in rows.columns])
        placed.repartition("leaf").sortWithinPartitions("leaf", key).write.mode("overwrite").partitionBy("leaf").parquet(f"{out.folder}/rows")
        columns = [F.col(f"`{c}`") for c in rows.columns]
        hashed = placed.select(F.lit(0).alias("level"), F.col("leaf").alias("node"), F.lit(1).cast("long").alias("n"), F.xxhash64(F.lit("a"), nulls, *columns).alias("a"), F.xxhash64(F.lit("b"), nulls, *columns).alias("b"))
        _sums(hashed, "level", "node").write.mode("overwrite").parquet(f"{out.folder}/tree/l=0")
        low, high = out.tree(0).agg(F.min("node"), F.max("node")).first()
        level = 0
        while low is not None and high - low >= FAN:
            level += 1
            below = _mixed(out.tree(level - 1))
            parents = below.select(F.lit(level).alias("level"), F.floor(F.col("node") / FAN).alias("node"), "n", "a", "b")
            _sums(parents, "level", "node").write.mode("overwrite").parquet(f"{out.folder}/tree/l={level}")
            low, high = low // FAN, high // FAN
        out.spark.createDataFrame([(level,)], "height int").write.mode("overwrite").parquet(f"{out.folder}/height")
        return out

    def height(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/height").first().height

    def tree(self, level: int) -> DataFrame:
        """A level's nodes: level, node, n, a, b."""
        return self.spark.read.parquet(f"{self.folder}/tree/l={level}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def nbytes(self, leaves: set[int] | None = None) -> int:
        """Bytes of the stored rows, or of those of some leaves."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/rows")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        folders = [s for s in fs.listStatus(path) if s.isDirectory()]
        wanted = [s for s in folders if leaves is None or int(s.getPath().getName().removeprefix("leaf=")) in leaves]
        return sum(fs.getContentSummary(s.getPath()).getLength() for s in wanted)


def differing(old: Snapshot, new: Snapshot) -> DataFrame:
    """leaf: the leaves whose rows aren't the same on both sides."""
    top = min(old.height(), new.height())
    suspect = None
    for level in range(top, -1, -1):
        sides = []
        for s in (old, new):
            nodes = s.tree(level)
            if suspect is not None:
                nodes = nodes.join(suspect.select(F.col("leaf").alias("parent")), F.floor(F.col("node") / FAN) == F.col("parent"), "left_semi")
            sides.append(nodes)
        x, y = (s.select("node", F.struct("n", "a", "b").alias(name)) for s, name in zip(sides, ("x", "y"), strict=True))
        suspect = x.join(y, "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("node").alias("leaf"))
    return suspect


def changes(old: Snapshot, new: Snapshot) -> tuple[DataFrame, dict[str, int]]:
    """key and change (`added`, `removed` or `changed`); and bytes_read of bytes_all stored ones."""
    leaves = differing(old, new)
    few = leaves.limit(PUSHED + 1).collect()
    bytes_all = old.nbytes() + new.nbytes()
    sides, read = [], bytes_all
    if len(few) <= PUSHED:
        known = {r.leaf for r in few}
        sides = [s.rows().where(F.col("leaf").isin(sorted(known))) for s in (old, new)]
        read = old.nbytes(known) + new.nbytes(known)
    else:
        sides = [s.rows().join(leaves, "leaf", "left_semi") for s in (old, new)]
    columns = [c for c in old.rows().columns if c != "leaf"]
    x, y = (s.select(old.key, F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name)) for s, name in zip(sides, ("x", "y"), strict=True))
    both = x.join(y, old.key, "full").where(~F.col("x").eqNullSafe(F.col("y")))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed")
    return both.select(old.key, change.alias("change")), {"bytes_read": read, "bytes_all": bytes_all}
