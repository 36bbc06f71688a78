"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Bytes of a batch of rows between Spark and a Python worker. A batch stands on both sides, once for each of an executor's tasks.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let this session's Python workers import the package from where the driver has it, and bound their batches.

    Enough where workers see the driver's files (local mode, an installed package);
    on other clusters ship the package with ``--py-files``. A session with smaller
    batches keeps them; rows are never cut, a batch holds one at least.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)) > BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    return spark
