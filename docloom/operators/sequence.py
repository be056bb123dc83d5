"""Operators on ordered rows.

`Ordered(df, by, order)` is a DataFrame whose rows have a total order inside each
`by` group (no `by`: one sequence of all rows). Rows are range-partitioned by (by,
order), so a huge group lies over many partitions in order; row counts of the earlier
partitions are added to the local numbers, and neighbour lookups use chunks of
consecutive positions that share a few rows with the next chunk. Every size takes this
one way; nothing is counted while the plan is made.

First-n of a whole table, keyed-distinct and first-match combine on the map side.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.arrays import binomial, subset_at
from docloom.functions.generate import explode_count
from docloom.session import durable

col = F.col

# Rows of consecutive positions handled together when groups are split.
CHUNK = 100_000

def hashed(columns: list[str], seed: int) -> Column:
    """Random key of a row: the same row and seed always give the same key."""
    return F.xxhash64(*columns, F.lit(seed))


class Ordered:
    def __init__(self, df: DataFrame, by=(), order=(), chunk: int = CHUNK, draw=hashed):
        self.df = df
        self.by = list(by)
        self.order = list(order)
        self.chunk = chunk
        self.draw = draw

    # -- how to run -------------------------------------------------------

    @cached_property
    def numbered(self) -> DataFrame:
        """Rows with `pos`, counted from 0 in each group."""
        spark = self.df.sparkSession
        shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = [*self.by, *self.order]
        # The shard of a row is stored, so a lost task cannot renumber others.
        placed = durable(
            self.df.repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
            .withColumn("_at", F.monotonically_increasing_id())
            .withColumn("_shard", F.shiftright("_at", 33))
        )
        sizes = placed.groupBy(*self.by, "_shard").agg(F.count("*").alias("_n"))
        earlier = Window.partitionBy(*(self.by or [F.lit(0)])).orderBy("_shard").rowsBetween(
            Window.unboundedPreceding, -1)
        # A shard starts inside at most one group, so this has at most one row a shard.
        carried = sizes.withColumn("_before", F.sum("_n").over(earlier)).filter(
            "_before IS NOT NULL").drop("_n")
        local = Window.partitionBy(*self.by, "_shard").orderBy("_at")
        numbered = placed.withColumn("_local", F.row_number().over(local).cast("bigint") - 1)
        same = col("l._shard") == col("c._shard")
        for k in self.by:
            same = same & col(f"l.`{k}`").eqNullSafe(col(f"c.`{k}`"))
        return numbered.alias("l").join(F.broadcast(carried.alias("c")), same, "left").select(
            *[col(f"l.`{c}`") for c in self.df.columns],
            (col("_local") + F.coalesce("_before", F.lit(0))).alias("pos"))

    def neighbours(self, wanted: dict[str, tuple[str, int]]) -> DataFrame:
        """Rows with `pos` and columns name -> (column, offset) taken from rows nearby.

        Positive offsets look ahead. The value is NULL where no such row exists.
        """
        values = {n: (c, o) for n, (c, o) in wanted.items()}

        def looked_up(window):
            return [F.lead(c, o).over(window) if o >= 0 else F.lag(c, -o).over(window)
                    for c, o in values.values()]

        ahead = max([o for _, o in values.values() if o > 0], default=0)
        behind = max([-o for _, o in values.values() if o < 0], default=0)
        size = max(self.chunk, ahead, behind, 1)
        home = F.floor(col("pos") / size)
        inside = col("pos") % size
        places = F.filter(F.array(
            home,
            F.when((inside < ahead) & (home > 0), home - 1),
            F.when(inside >= size - behind, home + 1),
        ), lambda c: c.isNotNull())
        spread = self.numbered.withColumn("_home", home).withColumn("_chunk", F.explode(places))
        window = Window.partitionBy(*self.by, "_chunk").orderBy("pos")
        named = [c.alias(n) for n, c in zip(values, looked_up(window))]
        return spread.select("*", *named).filter("_chunk = _home").drop("_chunk", "_home")

    # -- flags and lookups ------------------------------------------------

    def first_flags(self) -> DataFrame:
        return self.numbered.withColumn("is_first", col("pos") == 0)

    def last_flags(self) -> DataFrame:
        """A row is last when no row follows it."""
        after = self.neighbours({"_next": ("pos", 1)})
        return after.withColumn("is_last", col("_next").isNull()).drop("_next")

    def peek(self, column: str, ahead: int = 0, name: str = "peeked") -> DataFrame:
        """The value `ahead` items after the next one, without moving."""
        return self.neighbours({name: (column, ahead + 1)})

    def pairs(self, *columns: str) -> DataFrame:
        """Adjacent pairs: each row but the last, with `next_<column>` values."""
        lookups = {f"next_{c}": (c, 1) for c in columns}
        paired = self.neighbours({**lookups, "_next": ("pos", 1)})
        return paired.filter("_next IS NOT NULL").drop("_next")

    # -- picking ----------------------------------------------------------

    def _ranked(self, keys, descending=False):
        order = [col(c).desc() if descending else col(c).asc() for c in self.order]
        return self.df.withColumn(
            "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def take(self, n: int) -> DataFrame:
        """First n rows of each group."""
        if not self.by:
            return self.df.orderBy(*self.order).limit(n)
        return self.numbered.filter(col("pos") < n).drop("pos")

    def tail(self, n: int) -> DataFrame:
        """Last n rows of each group."""
        if not self.by:
            return self.df.orderBy(*[col(c).desc() for c in self.order]).limit(n).orderBy(*self.order)
        sizes = self.numbered.groupBy(*self.by).agg(F.count("*").alias("_size")).alias("r")
        rows = self.numbered.alias("l")
        same = reduce(lambda a, b: a & b, [col(f"l.`{k}`").eqNullSafe(col(f"r.`{k}`")) for k in self.by])
        return rows.join(sizes, same).filter(col("pos") >= col("_size") - n).select(
            *[col(f"l.`{c}`") for c in self.df.columns])

    def nth(self, n: int, column: str, default=None, name: str = "nth") -> DataFrame:
        """The item at position n (from 0) of each group, or the default."""
        rows, at = self.numbered, col("pos") == n
        return rows.groupBy(*self.by).agg(
            F.when(F.bool_or(at), F.max(F.when(at, col(column))))
            .otherwise(F.lit(default)).alias(name))

    def first_seen(self, *key: str) -> DataFrame:
        """First row of every distinct key in each group."""
        return self._ranked([*self.by, *key]).filter(col("_rank") == 1).drop("_rank")

    def without_repeats(self, *key: str) -> DataFrame:
        """Rows whose key differs from the row just before."""
        before = self.neighbours({f"_was_{k}": (k, -1) for k in key})
        same = F.lit(True)
        for k in key:
            same = same & col(k).eqNullSafe(col(f"_was_{k}"))
        return before.filter((col("pos") == 0) | ~same).drop(*[f"_was_{k}" for k in key])

    def first_true(self, predicate: Column, column: str, default=None,
                   name: str = "found") -> DataFrame:
        """The first item of each group that satisfies the predicate, or the default."""
        at = F.struct(*self.order)
        return self.df.groupBy(*self.by).agg(
            F.when(F.bool_or(predicate), F.min_by(F.when(predicate, col(column)), F.when(predicate, at)))
            .otherwise(F.lit(default)).alias(name))

    # -- blocks and interleaving ------------------------------------------

    def blocks(self, n: int, column: str, fill=None, name: str = "items") -> DataFrame:
        """Blocks of n items; the last one is padded with `fill`."""
        inside = F.struct(col("pos"), col(column).alias("x"))
        grouped = self.numbered.groupBy(
            *self.by, F.floor(col("pos") / n).alias("block")
        ).agg(F.array_sort(F.collect_list(inside)).alias("_items"))
        items = F.transform("_items", lambda i: i["x"])
        padding = F.array_repeat(F.lit(fill), F.lit(n) - F.size("_items"))
        return grouped.select(*self.by, "block", F.concat(items, padding).alias(name))

    def interleave(self, source: str) -> DataFrame:
        """Round robin over the sources of each group: rows with `slot`, their place in it.

        One item of every source in turn, by source value; finished sources drop out.
        """
        by_source = Ordered(
            self.df, [*self.by, source], self.order, self.chunk)
        turns = by_source.numbered.withColumnRenamed("pos", "_turn")
        merged = Ordered(turns, self.by, ["_turn", source], self.chunk)
        return merged.numbered.withColumnRenamed("pos", "slot").drop("_turn")

    # -- sampling ---------------------------------------------------------
    #
    # Random keys are hashes of the order columns and a seed, so a recomputed task
    # draws the same rows again.

    def _drawn(self, seed: int) -> DataFrame:
        return self.df.withColumn("_draw", self.draw([*self.by, *self.order], seed))

    def choose_each(self, column: str, repeat: int = 1, seed: int = 0) -> DataFrame:
        """One random item of every pool (`by`), drawn `repeat` times."""
        keys = [self.draw([*self.by, *self.order], seed + i) for i in range(repeat)]
        wide = self.df.select(
            *self.by, column, *[k.alias(f"_draw{i}") for i, k in enumerate(keys)])
        picks = wide.groupBy(*self.by).agg(
            *[F.max_by(column, f"_draw{i}").alias(f"_pick{i}") for i in range(repeat)])
        return picks.select(*self.by, F.posexplode(
            F.array(*[f"_pick{i}" for i in range(repeat)])).alias("round", column)
        ).withColumn("round", col("round").cast("bigint"))

    def permutation(self, r: int | None = None, seed: int = 0) -> DataFrame:
        """All rows, or r of them, in random order (no groups)."""
        drawn = self._drawn(seed)
        keys = ["_draw", *self.order]
        if r is None:
            return drawn.orderBy(*keys).drop("_draw")
        return drawn.orderBy(*keys).limit(r).drop("_draw")

    def combination(self, r: int, seed: int = 0) -> DataFrame:
        """r random rows in their own order."""
        return self.permutation(r, seed).orderBy(*self.order)

    def combination_with_replacement(self, r: int, seed: int = 0) -> DataFrame:
        """r random draws, rows may repeat, in their own order."""
        numbered = self.numbered
        n = self.df.count()
        draws = self.df.sparkSession.range(r).select(
            F.pmod(self.draw(["id"], seed), F.lit(max(n, 1))).alias("pos"))
        # Equal draws are counted first, then repeated.
        counted = draws.groupBy("pos").agg(F.count("*").alias("_times"))
        return explode_count(numbered.join(counted, "pos"), col("_times"), "copy").drop(
            "_times").orderBy("pos", "copy")


def cycles(df: DataFrame, n: int) -> DataFrame:
    """The whole sequence n times; `cycle` numbers the copies from 0."""
    return explode_count(df.withColumn("_n", F.lit(n).cast("bigint")), col("_n"), "cycle").drop(
        "_n").withColumn("cycle", col("cycle") - 1)


def subset_rows(df: DataFrame, items: str, largest: int | None = None) -> DataFrame:
    """One row for every subset of the array `items`: the row's columns, `size`, and `subset`.

    Subsets are numbered by size, then by the positions of their members, and each row works
    out its own from its number; none is held beside another. `largest` bounds the size.
    """
    n = F.coalesce(F.size(items), F.lit(0))
    top = n if largest is None else F.least(n, F.lit(largest))
    sizes = F.sequence(F.lit(0).cast("bigint"), top.cast("bigint"))
    sized = df.filter(col(items).isNotNull()).withColumn("size", F.explode(sizes))
    ranked = explode_count(sized, binomial(n, col("size")), "_rank")
    return ranked.withColumn("subset", F.transform(
        subset_at(n, col("size"), col("_rank") - 1), lambda i: F.get(items, i))).drop("_rank")
