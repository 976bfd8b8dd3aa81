"""Lines, windows, scopes and chunks with exact byte ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import stabbed

MAX_TOKENS, OVERLAP, LEAST_FILE, LEAST_WINDOW = 250, 50, 50, 50


def _cut_lines(with_text: bool):
    """Lines of a column of bytes, by their row: where each starts and ends, found in the column's one buffer."""

    def run(batches):
        for batch in batches:
            content = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(content.buffers()[1], dtype=np.int64)[content.offset : content.offset + len(content) + 1]
            raw = content.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
            breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0] if len(content) else np.zeros(0, dtype=np.int64)
            of = np.searchsorted(breaks, offsets)
            many = np.diff(of) + 1
            row = np.repeat(np.arange(len(content)), many)
            line = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first, last = line == 0, line == many[row] - 1
            start, end = offsets[:-1][row], offsets[1:][row]
            start[~first], end[~last] = breaks + 1, breaks
            columns = [batch.column(0).take(pa.array(row)), pa.array((line + 1).astype(np.int32)), pa.array(start - offsets[:-1][row]), pa.array(end - offsets[:-1][row])]
            names = [batch.schema.names[0], "line", "byte_start", "byte_end"]
            step = 1 << 16
            for i in range(0, len(row), step):
                part = [c.slice(i, step) for c in columns]
                if with_text:
                    part.append(pa.array([data[a:b].tobytes() for a, b in zip(start[i : i + step].tolist(), end[i : i + step].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(part, names=[*names, "line_bytes"] if with_text else names)

    return run


def line_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key, line (from 1), byte_start and byte_end, and line_bytes if with_text; a line's end excludes its line break.

    A row's lines are cut where it is: nothing is shuffled. Null counts as empty, which is one line.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, line int, byte_start long, byte_end long" + ", line_bytes binary" * with_text
    return docs.select(key, F.col(text).cast("binary").alias("_content")).mapInArrow(_cut_lines(with_text), schema)


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """First tokens of windows over n tokens: steps of size - overlap, 1 at least, below n."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), (n - 1).cast("int"), F.lit(max(1, size - overlap)).cast("int"))).otherwise(F.array().cast("array<int>"))


def fixed_windows(tokenised: DataFrame, key: str, column: str, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_id, token_start, n_tokens and chunk_text: overlapping windows over an array of tokens, joined by blanks."""
    starts = tokenised.select(key, column, F.posexplode(window_starts(F.size(column), size, overlap)).alias("chunk_id", "token_start"))
    part = F.slice(column, F.col("token_start") + 1, F.lit(size))
    return starts.select(key, "chunk_id", "token_start", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk_text"))


def deepest_scopes(scopes: DataFrame, files: DataFrame) -> DataFrame:
    """path, line, name and kind of the smallest scope that covers each line of a file; of equal spans the last listed; null if none.

    scopes: path, name, kind, start_line, end_line, ordinal. files: path, n_lines.
    Scopes meet lines in the sweep of `intervals.stabbed`: a scope costs a row for each bin of lines, however many it covers.
    """
    known = scopes.select("path", F.col("start_line").alias("start"), (F.col("end_line") + 1).alias("end"), "ordinal", "name", "kind")
    lines = files.where("n_lines > 0").select("path", F.explode(F.sequence(F.lit(1), F.col("n_lines").cast("int"))).alias("at"))
    return stabbed(known, lines, "path", "name", "kind").select("path", F.col("at").cast("int").alias("line"), "name", "kind", "ordinal")


def islands(lines: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """Runs of consecutive lines of one scope: path, island, scope_name, scope_type, start_line, end_line.

    lines: path, line, name, kind, ordinal. With text (path, line, line_text), runs of blank lines only are left out.
    """
    order = Window.partitionBy("path").orderBy("line")
    same = F.col("ordinal").eqNullSafe(F.lag("ordinal").over(order)) & (F.row_number().over(order) > 1)
    cut = lines.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    if text is not None:
        cut = cut.join(text.select("path", "line", "line_text"), ["path", "line"])
    full = F.max(F.trim(F.regexp_replace("line_text", r"[\t\r\f\x0B]", " ")) != "") if text is not None else F.lit(True)
    runs = cut.groupBy("path", "_island").agg(
        F.first("name").alias("_name"), F.first("kind").alias("_kind"), F.first("ordinal").alias("ordinal"), F.min("line").alias("start_line"), F.max("line").alias("end_line"), full.alias("_full")
    )
    runs = runs.where("_full")
    number = (F.row_number().over(Window.partitionBy("path").orderBy("start_line")) - 1).alias("island")
    return runs.select("path", number, F.coalesce("_name", F.lit("Global")).alias("scope_name"), F.coalesce("_kind", F.lit("global")).alias("scope_type"), "start_line", "end_line", "ordinal")
