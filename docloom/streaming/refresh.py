"""Incremental extraction from a growing table of source snapshots.

Snapshots (modname, version, path, mtime, size, source) arrive as Parquet files, in any order.
The state of the stream is the newest fingerprint of every module, and it is kept where the
results are: in the index of the cache, committed with them. A micro-batch extracts only
snapshots that are newer than that state, so a late older one changes nothing, and a batch
that is run again after its commit finds nothing to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import durable
from docloom.sources import cache

SNAPSHOT = (
    "modname string, version int, path string, mtime double, size bigint, source string")

# Which of two snapshots of a module is the newer one.
AGE = ("mtime", "version", "size", "path")


def _newest(snapshots: DataFrame) -> DataFrame:
    """One snapshot per module, the latest by mtime; combines before the shuffle."""
    return snapshots.groupBy("modname").agg(
        F.max_by(F.struct("version", "path", "mtime", "size", "source"), F.struct(*AGE)).alias("s")
    ).select("modname", "s.*")


def newer(snapshots: DataFrame, state: DataFrame) -> DataFrame:
    """Snapshots that are newer than the state's fingerprint of their module, or of unknown modules."""
    known = state.select(F.col("modname").alias("_known"), F.struct(*AGE).alias("_age"))
    return snapshots.join(known, F.col("modname") == F.col("_known"), "left").filter(
        F.col("_known").isNull() | (F.struct(*AGE) > F.col("_age"))).select(*snapshots.columns)


def refresh_batch(batch: DataFrame, batch_id: int, folder: str) -> None:
    spark = batch.sparkSession
    todo = durable(newer(_newest(batch), cache.index(spark, folder)))
    if not todo.isEmpty():
        cache.commit(spark, folder, cache.entries_of(todo), todo, f"batch-{batch_id}")


def refresh_available(spark: SparkSession, snapshots: str, folder: str, checkpoint: str) -> None:
    """Process all snapshots that have arrived since the last call, then stop."""
    stream = spark.readStream.schema(SNAPSHOT).parquet(snapshots)
    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: refresh_batch(batch, batch_id, folder))
        .start()
    )
    query.awaitTermination()
