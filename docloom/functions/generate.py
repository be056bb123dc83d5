"""Row generators that stay splittable for any count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 65_536


def explode_rows(df: DataFrame, keep: list, values: Column, item: str,
                 pos: str = "pos") -> DataFrame:
    """One row per array element with its position (bigint, from 0); empty arrays give none.

    The plain generator lets the optimizer push `size(values) > 0` below it, which
    computes the array again, even before a shuffle. For arrays that cost something
    the outer form, filtered afterwards, computes it once.
    """
    return (
        df.select(*keep, F.posexplode_outer(values).alias(pos, item))
        .filter(F.col(pos).isNotNull())
        .withColumn(pos, F.col(pos).cast("bigint"))
    )


def explode_count(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Repeat each row n times, numbering the copies 1..n in column `name`.

    Two exploded levels keep every array short, however large n is; the blocks
    of one row are spread over tasks when a shuffle follows the first level.
    """
    blocks = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / STEP)))
    low = F.col("_block") * STEP + 1
    high = F.least(n, low + (STEP - 1))
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn(name, F.explode(F.sequence(low, high)))
        .drop("_block")
    )
