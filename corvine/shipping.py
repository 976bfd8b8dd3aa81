"""Makes this package importable in the Python workers of whatever cluster the session is on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Arrow batches of this size at most, so that a worker's memory follows neither row widths nor Spark's default of 64 MB.
BATCH_BYTES = "8m"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application, once; Spark hands it to every executor. Bounds the session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp()) / "corvine_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
