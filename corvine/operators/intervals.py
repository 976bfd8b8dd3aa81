"""Which interval covers a point most closely: a stabbing join by bins and a sweep.

Positions are cut into bins of SPAN. An interval goes to each bin that it meets, a point to its own, and
a bin is swept once in order of position with a heap of the intervals that are open. So an interval costs
a row for each SPAN positions that it covers, not for each position, no pairs of points and intervals are
formed, and one long group (a page of a million lines) is as many pieces as it has bins.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SPAN = 1 << 16


def _sweep(keep: list[str], names: list[str], kinds: list[pa.DataType]):
    """Of rows in order of group, bin, position and kind (intervals before points): the points, each with the open interval of the smallest span, then the largest ordinal."""

    def run(batches):
        now, heap, n = None, [], 0  # n: so that equal intervals never compare what they carry
        for batch in batches:
            out: list[tuple] = []
            for g, b, at, end, span, ordinal, *payload in zip(*(batch.column(c).to_pylist() for c in ("stab_group", "stab_bin", "at", "stab_end", "stab_span", "ordinal", *keep)), strict=True):
                if (g, b) != now:
                    now, heap = (g, b), []
                if end is not None:
                    heapq.heappush(heap, (span, -ordinal, n, end, payload))
                    n += 1
                    continue
                while heap and heap[0][3] <= at:
                    heapq.heappop(heap)
                out.append((g, at, -heap[0][1], *heap[0][4]) if heap else (g, at, None, *[None] * len(keep)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return run


def stabbed(intervals: DataFrame, points: DataFrame, group: str, *keep: str, span: int = SPAN) -> DataFrame:
    """group, at, ordinal and the columns of `keep`: a row for each of `points` (group, at), with the interval (group, start, end, ordinal, ...) that covers it most closely, or nulls.

    An interval covers start <= at < end. The smallest one counts, of equal ones the one with the largest ordinal.
    Nulls in group, at, start or end take no part; an interval that ends where it starts covers nothing.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span)))
    spread = intervals.where("start < end").select(F.col(group).alias("stab_group"), "start", F.col("end").cast("long").alias("stab_end"), "ordinal", *keep, bins.alias("stab_bin"))
    opened = spread.select("stab_group", "stab_bin", F.greatest(F.col("start"), F.col("stab_bin") * span).cast("long").alias("at"), F.lit(0).alias("stab_kind"), "stab_end", (F.col("stab_end") - F.col("start")).cast("long").alias("stab_span"), F.col("ordinal").cast("long").alias("ordinal"), *keep)
    none = [F.lit(None).cast(opened.schema[c].dataType).alias(c) for c in ("stab_end", "stab_span", "ordinal", *keep)]
    asked = points.where(F.col(group).isNotNull() & F.col("at").isNotNull()).select(F.col(group).alias("stab_group"), F.floor(F.col("at") / span).alias("stab_bin"), F.col("at").cast("long").alias("at"), F.lit(1).alias("stab_kind"), *none)
    rows = opened.where(F.col("stab_group").isNotNull()).unionByName(asked)
    placed = rows.repartition("stab_group", "stab_bin").sortWithinPartitions("stab_group", "stab_bin", "at", "stab_kind")
    fields = [rows.schema[c] for c in ("stab_group", "at", "ordinal", *keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    found = placed.mapInArrow(_sweep(list(keep), [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]), schema)
    return found.withColumnRenamed("stab_group", group)


def _tags(names: list[str]):
    pattern = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)")
    wanted = set(names)

    def run(batches):
        for batch in batches:
            key, at, name, closing, length = [], [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for m in pattern.finditer(text or ""):
                    if (tag := m[2].lower()) in wanted:
                        key.append(k)
                        at.append(m.start())
                        name.append(tag)
                        closing.append(bool(m[1]))
                        length.append(len(text))
            yield pa.RecordBatch.from_arrays([pa.array(key, batch.schema.field(0).type), pa.array(at, pa.int64()), pa.array(name, pa.string()), pa.array(closing, pa.bool_()), pa.array(length, pa.int64())], names=[batch.schema.names[0], "at", "name", "closing", "length"])

    return run


def tags(pages: DataFrame, key: str, html: str, *names: str) -> DataFrame:
    """key, at (character), name, closing and length (of the page), a row for each tag of these names; nothing is shuffled."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(_tags([*names]), f"`{key}` {kind}, at long, name string, closing boolean, length long")


def elements(tagged: DataFrame, key: str) -> DataFrame:
    """key, name, start, end and ordinal (its start): an element from its opening tag to the closing one of the same name and depth, or to the page's end."""
    by_name = Window.partitionBy(key, "name").orderBy("at")
    depth = F.sum(F.when(F.col("closing"), -1).otherwise(1)).over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    level = depth + F.col("closing").cast("int")  # of an element both tags have the same
    placed = tagged.withColumn("level", level)
    same = Window.partitionBy(key, "name", "level").orderBy("at")
    paired = placed.withColumn("next", F.lead("at").over(same)).withColumn("closes", F.lead("closing").over(same))
    end = F.when(F.col("closes"), F.col("next")).otherwise(F.col("length"))
    return paired.where(~F.col("closing")).select(key, "name", F.col("at").alias("start"), end.alias("end"), F.col("at").alias("ordinal"))
