"""Array and map expressions: vectors, flattening, subsets, ranges, map differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind `value` once for use inside `body`.

    A lambda variable holds the computed value, so an expensive array is not
    recomputed for each element when `body` itself loops.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(
        F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n),
        lambda x, y: x.cast("double") * y.cast("double"),
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def flatten_once(nested: Column) -> Column:
    return F.flatten(nested)


def repeat_value(value: Column, times: Column | int) -> Column:
    return F.array_repeat(value, times)


def binomial(n: Column, k: Column) -> Column:
    """Number of subsets of k out of n; every step of the product is a whole number."""
    zero = F.lit(0).cast("bigint")
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    product = F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, i: _div(acc * (n - k + i), i))
    return F.when((k < 0) | (k > n), zero).otherwise(product)


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of numbers that divide."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def subset_at(n: Column, k: Column, rank: Column) -> Column:
    """Positions of the subset of k out of n with this rank (from 0) in the order of positions.

    With a position taken, C(m, k - 1) subsets of the m later ones go on from it; a rank below
    that takes the position, another one leaves it and is lowered by that much. The count is
    updated from step to step.
    """
    state = F.struct(
        rank.cast("bigint").alias("rank"), k.cast("bigint").alias("k"), binomial(n - 1, k - 1).alias("c"),
        F.array().cast("array<int>").alias("at"))

    def step(acc, i):
        m, c = n.cast("bigint") - 1 - i, acc["c"]
        take = (acc["k"] > 0) & (acc["rank"] < c)
        later = F.greatest(m, F.lit(1))
        return F.struct(
            F.when(take, acc["rank"]).otherwise(acc["rank"] - c).alias("rank"),
            F.when(take, acc["k"] - 1).otherwise(acc["k"]).alias("k"),
            _div(c * F.when(take, acc["k"] - 1).otherwise(m - acc["k"] + 1), later).alias("c"),
            F.when(take, F.concat(acc["at"], F.array(i))).otherwise(acc["at"]).alias("at"))

    places = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, state, step, lambda acc: acc["at"])


def span(start: Column, end: Column, step: int = 1, inclusive=None) -> Column:
    """Arithmetic range. `inclusive`: None = start only, a bool = both ends, or a pair."""
    with_start, with_end = (
        (True, False) if inclusive is None
        else (inclusive, inclusive) if isinstance(inclusive, bool)
        else inclusive
    )
    first = start if with_start else start + F.lit(step)
    values = F.sequence(first, end, F.lit(step))
    if not with_end:
        values = F.filter(values, lambda v: v < end)
    return F.when(first <= end, values).otherwise(F.filter(F.array(start), lambda v: F.lit(False)))


def changed_entries(old: Column, new: Column) -> Column:
    """Entries of `new` whose value differs from `old`; both maps must have the same size."""
    changed = F.map_filter(new, lambda k, v: ~v.eqNullSafe(F.try_element_at(old, k)))
    return F.when(F.size(old) == F.size(new), changed)
