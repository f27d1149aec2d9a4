"""How many rows and bytes a task hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Whole texts pass through, so bytes bound the memory of a task; a single row may be larger.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000}


def small(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to LIMITS; smaller settings stay."""
    for key, most in LIMITS.items():
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
