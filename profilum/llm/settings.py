"""Session settings that the operators of this folder want."""

from __future__ import annotations

from pyspark.sql import SparkSession

from profilum.session import steady_unions

BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound what goes to a Python worker at once by bytes, since texts differ in length by orders of magnitude."""
    steady_unions(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
