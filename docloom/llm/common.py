"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["CHECK_SQL", "QUERIES", "durable", "lower_ascii", "maybe_in", "query", "small_batches", "table", "words", "written"]


def query(name: str, sql: str | None = None):
    """Register `fn(spark, folder) -> DataFrame`."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a frame that is made and run within go as soon as its result is there.

    They are of no use behind a checkpoint or a written table, and would otherwise stay until
    the driver happens to collect its garbage.
    """
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """`session.durable`, whose shuffle files go as soon as the result is written."""
    with _shuffles_go(df.sparkSession):
        # The setting holds for frames made under it, so `df` is made anew.
        return session.durable(df.select("*"))


def written(*parts: DataFrame) -> DataFrame:
    """`session.written` of the union of `parts`, one after another: shuffle files of a part go before the next runs."""
    spark = parts[0].sparkSession
    path = session.shared_folder(spark, "table")
    with _shuffles_go(spark):
        for df in parts:
            df.select("*").write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


# Bits of the filter of `maybe_in`, 1 MB in rows of 64.
BITS = 1 << 23


def maybe_in(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows of `df` whose `columns` may be those of a row of `keys`: none that are is lost, few others stay.

    It goes before a shuffle of `df` for a join with `keys`, which still decides; a semi-join would be
    pushed below it. The broadcast has at most `BITS` / 64 rows for inputs of any size; where keys near
    the number of its bits, more rows stay.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(BITS))
    bits = keys.select(place.alias("_place")).groupBy(F.expr("_place div 64").alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_place % 64 as int)))").alias("_bits"))
    return (df.withColumn("_place", place).withColumn("_word", F.expr("_place div 64")).join(F.broadcast(bits), "_word")
            .filter("getbit(_bits, cast(_place % 64 as int)) = 1").select(*df.columns))


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with Arrow batches of at most 500 rows, so that long texts fit a Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df


def lower_ascii(text: Column) -> Column:
    """Only A-Z become small; `lower` does that on plain ASCII, and much faster."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, upper, small)))


def words(text: Column, gap: str = SPACE) -> Column:
    """The runs between gaps; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")
