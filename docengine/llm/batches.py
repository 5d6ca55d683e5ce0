"""Rows of an Arrow batch, for operators whose rows are whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts in a batch; Spark's own 10,000 would be hundreds of MB of long ones, in the JVM and in the worker.
TEXTS = 1000


def bounded(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``TEXTS``, if it was not set to less."""
    known = spark.conf.get(SETTING, None)
    if known is None or not 0 < int(known) <= TEXTS:
        spark.conf.set(SETTING, str(TEXTS))
