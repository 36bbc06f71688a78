"""Incremental folding of an append-only set of chunk files into running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ["bucket", "expert"]
SUMS = ["cnt", "gat", "s", "sq"]


def sums(chunk: DataFrame) -> DataFrame:
    """Running sums of a set of observations (bucket, expert, gate, norm)."""
    s = F.col("gate") * F.col("norm")
    return chunk.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cnt"), F.sum("gate").alias("gat"), F.sum(s).alias("s"), F.sum(s * s).alias("sq"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def fold(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str, files_per_batch: int = 2) -> DataFrame:
    """Folds the files that were not folded yet and returns the sums.

    Each micro-batch writes version ``batch + 1`` of the sums from version ``batch``
    and the batch. Offsets are in the checkpoint, so a batch that is run again after
    a failure overwrites its own version: every file counts once.
    """
    def step(batch: DataFrame, number: int) -> None:
        new = sums(batch)
        if number:
            if not _exists(spark, f"{state}/v={number}/_SUCCESS"):
                raise FileNotFoundError(f"batch {number} follows sums that are missing in {state}/v={number}")
            new = merged(spark.read.parquet(f"{state}/v={number}"), new)
        bad = new.where("cnt < 0 or isnan(s) or isnan(sq) or sq < 0")
        if not bad.isEmpty():  # verified before it is kept
            raise ValueError("sums that are not finite and non-negative")
        new.write.mode("overwrite").parquet(f"{state}/v={number + 1}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = _committed(spark, checkpoint)
    if last is None or not _exists(spark, f"{state}/v={last + 1}/_SUCCESS"):
        raise FileNotFoundError(f"{checkpoint} has committed batch {last}, whose sums are missing in {state}")
    return spark.read.parquet(f"{state}/v={last + 1}")


def _committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The last batch that a checkpoint has committed; sums of other checkpoints beyond it don't count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(x) for x in names if x.isdigit()), default=None)
