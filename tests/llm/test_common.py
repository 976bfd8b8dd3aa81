from pathlib import Path

from corvine.llm.common import clear_cuts, cuts_folder, durable, fresh, one_per_id, one_row_per_id, shared_folder


def test_cuts_lie_in_the_shared_folder(spark):
    cut = durable(spark.range(5))
    folder = Path(cuts_folder(spark).removeprefix("file://"))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir") and cut.count() == 5
    assert any(folder.iterdir()) and all(f.startswith(f"file://{folder}") for f in cut.inputFiles())
    clear_cuts(spark)
    assert not folder.exists()


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id", "id as ROW", "id as row_")
    assert fresh(df, "row", "row", "id") == ["row__", "row___", "id_"]


def test_ids_are_not_gathered_in_one_task(spark):
    """Cutting down repeats, the ids of all documents stay as many tasks as the shuffle has."""
    seen = []
    docs = spark.range(1000).selectExpr("id % 900 as doc_id", "cast(id as string) as text", "'x' as repeated_id", "1 as best_row")

    def watch(self, path, *args, **kw):
        seen.append(self._df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, path, *args, **kw)

    from pyspark.sql.classic.dataframe import DataFrameWriter

    write, DataFrameWriter.parquet = DataFrameWriter.parquet, watch
    try:
        assert one_row_per_id(docs).count() == one_per_id(docs).count() == 900 and one_row_per_id(docs).columns == docs.columns
    finally:
        DataFrameWriter.parquet = write
    assert seen and not any("Repartition 1" in plan or "Coalesce" in plan for plan in seen)
