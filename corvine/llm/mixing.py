"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources, in code point order with null last, weigh 5, 2, 1 and again 5, 2, 1; together they are to
give `share` times all words. A target stops at `most` times its source's size, and the excess goes
to the other sources by weight until none is above: targets are min(most * size, level * weight)
with one water level for all.

A source takes its documents floor(target / size) times whole. What is then left of its budget
goes, word by word, down the list of its documents sorted by the key -ln(u) / w, where u is a hash
of the doc_id and w the document's quality weight: Efraimidis-Spirakis sampling without
replacement, in which the document that crosses the budget gives its first words only. A budget is
met to the word, and reruns agree.

A hot source isn't sorted in one task: keys are cut into ranges of about RANGE_ROWS documents, or of
the square root of the source's number where that is more, the ranges' sums are added up, and
documents are summed within their range. Only per-source and per-range sums go through a window.
How keys spread follows from the source's weights, counted in eighths of an octave: the share of
keys up to x is the mean of 1 - exp(-w x), so ranges of that share hold about equally many documents.

Cases: a null text has size 0; a document of size 0 takes 0; a null source is a source of its own;
repeated rows are documents of their own, their ties broken by doc_id; null weights count as 1 and
weights must be above 0; an empty table, or one without words, takes nothing; other columns of
`docs` are not looked at by `mix` and all kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
RANGE_ROWS = 2_000
#: Steps of an octave in which weights are counted; they only decide how even ranges are.
STEPS = 8
#: Weights of documents that labels.quality marks 1 and 0, and of those without a mark.
GOOD, BAD, UNMARKED = 2.0, 0.5, 1.0


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str):
    """A number above 0 and below 1 from doc_id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"/{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, n, source_size -> with target. One row for each source."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("long"))
    # Sources in the order in which a rising level meets their limits; the level stands where the first of them isn't met.
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy(F.lit(0))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    met = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    final = met.withColumn("at", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    return final.select("source", "n", "source_size", F.least(most * F.col("source_size"), F.coalesce(F.col("at") * F.col("weight"), most * F.col("source_size"))).cast("double").alias("target"))


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left.source.eqNullSafe(right._source), "inner").drop("_source")


def key_shares(sized: DataFrame) -> DataFrame:
    """_source and _kinds: an array of weights and of the share of the source's documents that have about that weight."""
    step = F.round(F.log2(F.col("weight")) * STEPS).cast("int").alias("step")
    counted = sized.groupBy("source", step).agg(F.count("*").alias("n"))
    kinds = counted.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("step", "n"))).alias("k"), F.sum("n").alias("all"))
    each = F.transform("k", lambda k: F.struct(F.pow(F.lit(2.0), k["step"] / F.lit(float(STEPS))).alias("w"), (k["n"] / F.col("all")).alias("share")))
    return kinds.select(F.col("source").alias("_source"), each.alias("_kinds"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs: doc_id, source, size and quality_weight. One row for each: doc_id, source, size, source_size, target, taken."""
    weight = F.coalesce("quality_weight", F.lit(1.0))
    sized = durable(docs.select("doc_id", "source", "size", weight.alias("weight"), (-F.log(draw(seed)) / weight).alias("key")))
    targets = durable(source_targets(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, share, most))
    kinds = key_shares(sized)
    targets = targets.join(kinds, targets.source.eqNullSafe(kinds._source)).drop("_source")
    share_below = F.aggregate("_kinds", F.lit(0.0), lambda s, k: s + k["share"] * (1 - F.exp(-k["w"] * F.col("key"))))
    ranges = F.ceil(F.col("n") / F.greatest(F.lit(float(range_rows)), F.sqrt("n")))
    d = _by_source(sized, targets).withColumn("range", F.floor(share_below * ranges)).drop("_kinds")
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    d = d.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    d = d.join(sums, d.source.eqNullSafe(sums._source) & (d.range == sums._range))
    within = Window.partitionBy("source", "range").orderBy("key", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("_ahead") - F.coalesce(F.sum("size").over(within), F.lit(0))
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), left))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, size and quality_weight; of several marks of a document the best counts. Texts are counted before the join, which moves no text."""
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("_mark"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    marked = sized.join(marks, "doc_id", "left")
    return marked.withColumn("quality_weight", F.when(F.col("_mark") == 1, GOOD).when(F.col("_mark") == 0, BAD).otherwise(UNMARKED)).drop("_mark")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle(documents: str = "documents") -> str:
    return f"""
WITH marks AS (SELECT doc_id, max(quality) AS mark FROM labels GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '/mix'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
           / (CASE mark WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM {documents} d LEFT JOIN marks m ON d.doc_id = m.doc_id),
weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(2 * coalesce(sum(source_size) OVER before, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), (SELECT max(level) FROM levels WHERE level * weight <= 2 * source_size) * weight) AS target
  FROM levels),
summed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target - epochs * source_size) AS BIGINT) - ahead)) AS BIGINT) AS taken
FROM summed
"""
