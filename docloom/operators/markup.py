"""Nesting of markup, as windows over tag events.

In a page that is nested rightly up to some event, the events of one depth alternate: a start
tag, its end tag, the next start tag, and so on. So the start that an end tag closes is the
event before it at the same depth, found by a window instead of a stack that grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import htmltext as H
from docloom.functions.generate import explode_rows

col = F.col


def nesting(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row a tag event: key, pos, tag, step (1 or -1), depth, and `other`, the tag of the
    start that an end closes, or of the end that closes a start. Right up to the first mismatch
    of a page; void tags and hidden elements are left out."""
    events = explode_rows(pages, [key], H.tag_events(col(html)), "e").select(
        key, "pos", col("e.tag").alias("tag"), col("e.step").cast("bigint").alias("step"))
    order = Window.partitionBy(key).orderBy("pos")
    # An end has the depth of its start.
    depth = F.sum("step").over(order) + F.when(col("step") < 0, 1).otherwise(0)
    near = Window.partitionBy(key, "depth").orderBy("pos")
    return events.withColumn("depth", depth).withColumn(
        "other", F.when(col("step") < 0, F.lag("tag").over(near)).otherwise(F.lead("tag").over(near)))


def first_mismatch(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Where the nesting of a page breaks first: key, pos (of the event), kind, tag, expected.

    `wrong end` closes another start than the innermost open one (`expected`), `stray end` closes
    none, and `no end` is the outermost start that is still open when the page ends. Pages
    nested rightly have no row.
    """
    end = col("step") < 0
    kind = (F.when(end & (col("depth") < 1), "stray end").when(end & (col("tag") != col("other")), "wrong end")
            .when(~end & col("other").isNull(), "no end"))
    problem = F.struct("pos", "kind", "tag", F.when(col("kind") == "wrong end", col("other")).alias("expected"))
    # What is left open only counts where no end tag is amiss before.
    rank = F.struct(col("kind") == "no end", "pos")
    return nesting(pages, key, html).withColumn("kind", kind).filter("kind IS NOT NULL").groupBy(key).agg(
        F.min_by(problem, rank).alias("p")).select(key, "p.*")
