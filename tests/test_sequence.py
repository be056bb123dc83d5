"""Both ways of running an ordered operator, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.sequence import Ordered, cycles

random.seed(5)
# One key holds half of all rows.
ROWS = [("hot" if i % 2 else f"k{i % 7}", i, random.choice("abc")) for i in range(600)]
GROUPS = {k: [(i, x) for g, i, x in ROWS if g == k] for k in {g for g, _, _ in ROWS}}


@pytest.fixture(params=["default", "short chunks"])
def seq(request, spark):
    shuffled = random.sample(ROWS, len(ROWS))
    df = spark.createDataFrame(shuffled, "g string, i bigint, x string").repartition(5)
    limits = {} if request.param == "default" else {"chunk": 8}
    return Ordered(df, ["g"], ["i"], **limits)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_positions(seq):
    want = [(g, i, n) for g, rows in GROUPS.items() for n, (i, _) in enumerate(rows)]
    assert got(seq.numbered, "g", "i", "pos") == sorted(want)


def test_flags(seq):
    want = [(g, i, n == 0) for g, rows in GROUPS.items() for n, (i, _) in enumerate(rows)]
    assert got(seq.first_flags(), "g", "i", "is_first") == sorted(want)
    want = [(g, i, n == len(rows) - 1) for g, rows in GROUPS.items() for n, (i, _) in enumerate(rows)]
    assert got(seq.last_flags(), "g", "i", "is_last") == sorted(want)


def test_neighbours(seq):
    def at(rows, n):
        return rows[n][1] if 0 <= n < len(rows) else None

    want = [(i, at(rows, n + 3), at(rows, n - 2)) for rows in GROUPS.values()
            for n, (i, _) in enumerate(rows)]
    near = seq.neighbours({"after": ("x", 3), "before": ("x", -2)})
    assert sorted(tuple(r) for r in near.select("i", "after", "before").collect()) == sorted(want)
    assert got(seq.peek("i"), "i", "peeked")[0][0] == 0


def test_pairs_and_repeats(seq):
    want = [(g, a[0], b[0]) for g, rows in GROUPS.items() for a, b in zip(rows, rows[1:])]
    assert got(seq.pairs("i"), "g", "i", "next_i") == sorted(want)
    want = [(g, next(r)[0]) for g, rows in GROUPS.items()
            for _, r in itertools.groupby(rows, key=lambda r: r[1])]
    assert got(seq.without_repeats("x"), "g", "i") == sorted(want)


def test_blocks_and_interleave(seq):
    want = []
    for g, rows in GROUPS.items():
        xs = [x for _, x in rows]
        for b in range(0, len(xs), 4):
            part = xs[b:b + 4]
            want.append((g, b // 4, part + ["-"] * (4 - len(part))))
    assert got(seq.blocks(4, "x", fill="-"), "g", "block", "items") == sorted(want)

    want = []
    for g, rows in GROUPS.items():
        queues = [[(i, x) for i, x in rows if x == s] for s in "abc"]
        turn = [q for t in itertools.zip_longest(*queues) for q in t if q is not None]
        want += [(g, i, n) for n, (i, _) in enumerate(turn)]
    assert got(seq.interleave("x"), "g", "i", "slot") == sorted(want)


def test_picking(seq):
    assert got(seq.take(3), "g", "i") == sorted((g, i) for g, r in GROUPS.items() for i, _ in r[:3])
    assert got(seq.tail(3), "g", "i") == sorted((g, i) for g, r in GROUPS.items() for i, _ in r[-3:])
    assert got(seq.take(2000), "g", "i") == sorted((g, i) for g, i, _ in ROWS)
    assert got(seq.tail(2000), "g", "i") == sorted((g, i) for g, i, _ in ROWS)
    want = [(g, r[60][0] if len(r) > 60 else -1) for g, r in GROUPS.items()]
    assert got(seq.nth(60, "i", default=-1), "g", "nth") == sorted(want)
    assert got(seq.nth(5000, "i", default=-1), "g", "nth") == sorted((g, -1) for g in GROUPS)
    want = [(g, next(i for i, x in r if x == s)) for g, r in GROUPS.items() for s in {x for _, x in r}]
    assert got(seq.first_seen("x"), "g", "i") == sorted(want)
    want = [(g, next((i for i, x in r if x == "b" and i > 590), -1)) for g, r in GROUPS.items()]
    found = seq.first_true((F.col("x") == "b") & (F.col("i") > 590), "i", default=-1)
    assert got(found, "g", "found") == sorted(want)


def test_sampling(spark):
    whole = Ordered(spark.range(500), (), ["id"])
    ids = [r.id for r in whole.permutation(seed=1).collect()]
    assert sorted(ids) == list(range(500)) and ids != sorted(ids)
    assert [r.id for r in whole.permutation(seed=1).collect()] == ids
    assert [r.id for r in whole.permutation(20, seed=1).collect()] == ids[:20]
    some = [r.id for r in whole.combination(20, seed=1).collect()]
    assert some == sorted(ids[:20])
    drawn = [r.id for r in whole.combination_with_replacement(900, seed=1).collect()]
    assert len(drawn) == 900 and drawn == sorted(drawn) and set(drawn) <= set(range(500))


def test_samples_of_a_whole_table(spark):
    whole = Ordered(spark.range(300), (), ["id"], chunk=16)
    small = Ordered(spark.range(300), (), ["id"])
    assert [r.id for r in whole.permutation(40, seed=3).collect()] == [
        r.id for r in small.permutation(seed=3).collect()][:40]
    assert sorted(r.id for r in whole.take(40).collect()) == list(range(40))
    assert sorted(r.id for r in whole.tail(40).collect()) == list(range(260, 300))


def test_cycles(spark):
    rows = cycles(spark.range(3), 70_000).groupBy("id").agg(
        F.count("*").alias("n"), F.min("cycle"), F.max("cycle")).collect()
    assert sorted(tuple(r) for r in rows) == [(i, 70_000, 0, 69_999) for i in range(3)]
