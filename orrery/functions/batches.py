"""The size of batches to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches to Python of 8 MB at most, as a worker holds several copies of one, unless the session has set its own size."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "8m")
