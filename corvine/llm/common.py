"""Shared plumbing of the training-data operators: tables, checkpoints and Arrow stages."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none uses its warehouse; a cluster has to name one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.master == "local" or context.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_corvine"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def cuts_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_folder(spark)}/corvine/{spark.sparkContext.applicationId}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Whether Spark deletes a query's shuffle files when it ends. A cut's rows are in its table then, and nothing else reads them.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written as Parquet in the shared folder and read back, and its folder. What it took to shuffle is deleted once it is written."""
    spark = df.sparkSession
    path = f"{cuts_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """`df` by way of the shared folder: lineage ends there and a lost executor takes nothing with it."""
    return written(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def clear_cuts(spark: SparkSession) -> None:
    """Deletes this application's durable tables and models. Results that read them must have been written before."""
    discard(spark, cuts_folder(spark))


def is_void(df: DataFrame) -> bool:
    return not df.take(1)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_python(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, with workers that give memory back: large arrays as soon as they are freed, the rest when a task ends."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _return_large_blocks()
        yield from run(batches)
        _release()

    return df.mapInArrow(lean, schema)


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: its own rules hold
        return None


@cache
def _return_large_blocks() -> None:
    """Keeps glibc from raising the size from which blocks are mapped, and so unmapped when freed.

    Options -3 and -1, M_MMAP_THRESHOLD and M_TRIM_THRESHOLD: what pieces need stays in the heap, as mapping it anew each time costs more than using it.
    """
    if _libc():
        _libc().mallopt(-3, 16 << 20)
        _libc().mallopt(-1, 64 << 20)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


#: Stands for a null doc_id where documents are compared by it.
NO_ID = -(1 << 63)


def one_per_id(docs: DataFrame) -> DataFrame:
    """doc_id and text, without nulls: a null doc_id becomes NO_ID, a null text empty; of rows that share a doc_id the largest text stays.

    Only doc_ids are shuffled, and the texts of those that repeat.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    again = durable(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if is_void(again):
        return rows
    return rows.join(again, "doc_id", "left_anti").unionByName(rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))


def with_flags(texts: DataFrame, flags: DataFrame) -> DataFrame:
    return texts.join(flags.select("doc_id", "ords"), "doc_id", "left")


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """`docs` with all its columns; of rows that share a doc_id the one with the largest text stays."""
    key, row = fresh(docs, "repeated_id", "best_row")
    again = durable(docs.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(row)).where(F.col(row) > 1).select(key))
    if is_void(again):
        return docs
    same = docs["doc_id"].eqNullSafe(again[key])
    best = docs.join(again, same, "left_semi").groupBy("doc_id").agg(F.max_by(F.struct("*"), F.coalesce("text", F.lit(""))).alias(row))
    return docs.join(again, same, "left_anti").unionByName(best.select(f"{row}.*"))


def by_ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to tasks by the number in the last of `keys`, evenly, and sorted by `keys` in each."""
    n = width(rows.sparkSession)
    return rows.repartitionById(n, F.pmod(F.col(keys[-1]), F.lit(n)).cast("int")).sortWithinPartitions(*keys)
