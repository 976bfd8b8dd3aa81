"""A live index: a stream that tells when a source tree has changed; each batch is compared with the index itself and committed.

What was indexed is the stream's state, so nothing else has to remember it: a batch lists the tree,
executors read and hash the files whose size or time differs from the index's, and what has another
content, is new or is gone becomes one commit. The same batch again changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.versions import latest
from ..plans.index import Index
from ..schemas import FILES
from ..sources.tree import file_row, stream_tree

PAUSE = "2 seconds"


def effective(deltas: DataFrame, files: DataFrame) -> DataFrame:
    """Of changes (action, path, md5, ts) the last of each path, if it changes what is indexed: another hash, a new path, or the end of a known one."""
    last = latest(deltas, "path", "ts", "action")
    known = files.select("path", F.col("md5").alias("_known"))
    joined = last.join(known, "path", "left")
    return joined.where(F.when(F.col("action") == "delete", F.col("_known").isNotNull()).otherwise(~F.col("md5").eqNullSafe(F.col("_known")))).drop("_known")


def suspects(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed paths that aren't indexed, or not with this size and time."""
    known = files.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = listing.join(known, "path", "left")
    return joined.where(~(F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime")))).select("path")


def contents(paths: DataFrame, root: str) -> DataFrame:
    """Rows of FILES, read and hashed by the executors; what vanished meanwhile is left to the next batch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    rows.append(file_row(root, path))
                except FileNotFoundError:
                    continue
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=FILES.names)

    return paths.select("path").mapInArrow(run, FILES)


def apply_batch(index: Index, root: str, listing: DataFrame) -> int | None:
    """Commits what differs between a listing (path, size, mtime) of the whole tree and the index; None if nothing does."""
    listing = listing.dropDuplicates(["path"]).persist()
    files = index.table("files")
    read = contents(suspects(listing, files), root).persist()
    try:
        changed = read.join(files.select("path", F.col("md5").alias("_md5")), "path", "left").where(~F.col("md5").eqNullSafe(F.col("_md5"))).drop("_md5")
        deleted = files.select("path").join(listing.where(F.lit(os.path.isdir(root))), "path", "left_anti")
        if not changed.take(1) and not deleted.take(1):
            return None
        return index.update(changed, deleted)
    finally:
        read.unpersist()
        listing.unpersist()


def watch(index: Index, root: str, checkpoint: str, pause: str = PAUSE, **trigger) -> StreamingQuery:
    """Starts the stream. A processing-time pause gathers bursts; errors stop the query, which then goes on from its checkpoint."""
    writer = stream_tree(index.spark, root).writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda listing, _: apply_batch(index, root, listing) and None).trigger(**(trigger or {"processingTime": pause})).start()
