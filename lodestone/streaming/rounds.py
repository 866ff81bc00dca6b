"""Active-learning rounds over a growing source of labels: an extension, since the workflows themselves are batch programs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.acquisition import convergence, upsert_history


def follow_history(labels: DataFrame, measure: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """For each micro-batch of labels measure the model and merge the metrics into the history at ``path``.

    ``measure(labels, epoch)`` gives rows (batch, rmse, SD, score). Each epoch writes a new version, so a repeated epoch does no harm.
    """

    def merge(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        new = measure(rows, epoch)
        old = read_history(spark, path, epoch)
        full = new if old is None else upsert_history(old, new)
        full.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return labels.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest version, or the latest before an epoch."""
    jvm, root = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    found = [int(s.getPath().getName()[6:]) for s in system.listStatus(root) if s.getPath().getName().startswith("epoch=")]
    found = [e for e in found if before is None or e < before]
    return spark.read.parquet(f"{path}/epoch={max(found)}") if found else None


def verdict(spark: SparkSession, path: str, tolerance: float = 0.05, patience: int = 2) -> DataFrame | None:
    history = read_history(spark, path)
    return None if history is None else convergence(history, tolerance, patience)
