"""How much goes to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of rows that go to a Python worker at once; Spark's own 64 MB would stand several times in a worker and once in the JVM.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers of at most BATCH_BYTES; a smaller setting stays."""
    if int(spark.conf.get(BATCH).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)
