"""From raw documents to a training mix: five stages of the operators in corvine.llm.

Each stage takes all rows that the one before kept, its decisions take effect, and all stages but
the last return the columns of documents. Between stages the rows are written as Parquet in the
shared folder and read again.

Cases, for all stages: an empty table gives an empty table; extra columns stay, whatever their names;
texts of any length are read whole. Each stage's docstring says what becomes of nulls, empty texts,
ties and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from corvine.llm.common import WORD, durable, fresh, one_row_per_id, table
from corvine.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates share at least 80 of 100 shingles of five words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language isn't found with a score of 0.5.

    Null and empty texts have no letters; rows that repeat, or have no doc_id, are judged one by one;
    between languages that score the same the first by name is taken, and its score is 0.5 at most then.
    Where no row has a language there is nothing to find, and all rows go.
    """
    ship(spark)
    return language_id.keep_identified(docs, language_id.LanguageModel.fit(language_id.learnable(docs)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines, long lines and whole short documents that occurred before; n_chars follows the text.

    No row goes but repeated ones: of rows that share a doc_id the one with the largest text stays. A null
    text stays null, an emptied one empty; the smallest doc_id, null before all, keeps what is shared.
    """
    ship(spark)
    cut = line_dedup.deduplicated(docs, line_dedup.LEAST_WORDS)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates.

    Null, empty and wordless texts are near nothing and stay; of rows that share a doc_id the one with the
    largest text stands for them; a null doc_id is smaller than all others.
    """
    ship(spark)
    return near_dedup.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words are benchmark text.

    Null, empty and wordless texts stay; rows that repeat, or have no doc_id, are judged one by one; an
    empty benchmark drops nothing.
    """
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, one row for each epoch of a document: all of its text, or in the last its first words, with `epoch`, `size`, the document's words, and `taken`, the row's.

    Null, empty and wordless texts have no words to take and go; of rows that share a doc_id the one with
    the largest text is mixed, and ties in the sampling go by doc_id; a null source is one of its own.
    Columns named `epoch`, `size` or `taken` give way to these.
    """
    ship(spark)
    rows = one_row_per_id(docs).drop("size", "taken", "epoch")
    (key,) = fresh(rows, "mixed_id", "epoch", "size", "taken")[:1]
    mixed = mixing.mix(mixing.with_quality(rows, table(spark, sf_dir, "labels"))).where("taken > 0")
    mixed = mixed.select(F.col("doc_id").alias(key), "size", "taken")
    found = rows.join(mixed, F.col("doc_id").eqNullSafe(F.col(key))).drop(key)
    epochs = found.select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("epoch"))
    epochs = epochs.withColumn("taken", F.least("size", F.col("taken") - (F.col("epoch") - 1) * F.col("size")))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("taken").cast("int")), "")
    cut = F.col("taken") < F.col("size")
    out = epochs.withColumn("text", F.when(cut, first).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: SQL can't express language identification.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
