"""Session settings and lineage cutting shared by the jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "docloom", **conf) -> SparkSession:
    """A session with the settings the jobs expect; `conf` keys use `__` for dots.

    Python workers find this package where the driver has it. On a cluster without a
    shared installation, pass `--py-files` a zip of the package as well.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.executorEnv.PYTHONPATH",
                os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")])))
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        # One machine only: executors and driver share this disk.
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


# Rows of an input that one task of row-wise heavy work takes.
ROWS_PER_TASK = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give row-wise heavy work enough tasks, each with a bounded number of rows.

    A small input may come as one or two splits and would keep the other cores idle;
    it is then hashed by its unique key, and so is one whose splits hold many rows. An
    input with enough splits is left as it is: no shuffle. `df` is read for its count, so
    it should be a table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * cores, -(-df.count() // ROWS_PER_TASK))
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks, key)


def durable(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and forget its lineage."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table of its own in the shared checkpoint folder.

    A checkpoint keeps the size that the planner once guessed, which joins multiply; over
    many rounds that number grows without bound. A written table is known by its files.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a `written` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        # Only tables of `written`, never an input that `df` may read as well.
        if folder.rpartition("/")[2].startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the checkpoint folder, which all executors can reach."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
