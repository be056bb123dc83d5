"""Periodic runs of words by maximal pairs.

The words of a batch of documents are numbered, each document with numbers of its own, so no
match leaves its document. Prefix doubling sorts the suffixes; a suffix whose first words
occur once drops out at once. The groups of suffixes that share `least` or more words are
walked bottom-up as LCP-interval trees. A node keeps the sorted places of its subtree, all of
them and by the word to their left (its classes). Where two children meet at a node of LCP
value L, a place of the smaller one is paired with the places of the larger one at a distance
d that is short enough (L + d words have exponent L / d + 1) and whose left word differs.
Such a pair is maximal on both sides, so the words from its first place to the end of its
second match are a run of period d as they stand: nothing is extended. A run of n periods is
met at the multiples of its period too; the least distance of a stretch is its period.

Class counts inside the distance window tell how many partners a place has, and a scan of the
window stops once it has them, so the walk costs about what it reports; the smaller child goes
into the larger. Everything is per document, in batches bounded by words; Spark deals out the
rows and nothing is shuffled. A document lies in one task and needs memory in proportion to
its words.

Null and empty texts have no words and no runs. Repeated rows give repeated results; a null
doc_id is no special case (its text stays as it is in the query). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import query, small_batches, table

LEAST, POWER = 6, 4
# Words sorted together; a longer document is sorted alone.
BLOCK = 200_000


def words(text: str | None) -> list[bytes]:
    """Split at the six ASCII blanks."""
    return (text or "").encode().split()


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks: the place at which a value's group begins in sorted order."""
    order = np.argsort(key, kind="stable")
    put = key[order]
    new = np.concatenate([[True], put[1:] != put[:-1]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return rank


def _refine(rank: np.ndarray, live: np.ndarray, other: np.ndarray, step: int) -> np.ndarray:
    """Split the groups of the places in `live` by `other` at `step` words further; places still tied."""
    n = len(rank)
    at = live + step
    far = np.where(at < n, other[np.minimum(at, n - 1)] + 1, 0)
    first = rank[live]
    order = np.argsort(first * (n + 1) + far, kind="stable")
    base, far, live = first[order], far[order], live[order]
    place = np.arange(len(live))
    old = np.concatenate([[True], base[1:] != base[:-1]])
    new = old | np.concatenate([[True], far[1:] != far[:-1]])
    begin = np.maximum.accumulate(np.where(new, place, 0))
    rank[live] = base + begin - np.maximum.accumulate(np.where(old, place, 0))
    size = np.bincount(np.cumsum(new) - 1)
    return live[np.repeat(size, size) > 1]


def repeated(codes: np.ndarray, least: int) -> list[np.ndarray]:
    """Groups of two or more places that share `least` words, each in suffix order."""
    rank = _dense(codes)
    one = rank.copy()
    live = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
    have = 1
    while have < least and len(live):
        twice = 2 * have <= least
        live = _refine(rank, live, rank.copy() if twice else one, have)
        have += have if twice else 1
    if not len(live):
        return []
    members, group = np.sort(live), rank.copy()
    while len(live):
        live = _refine(rank, live, rank.copy(), have)
        have *= 2
    order = members[np.argsort(rank[members], kind="stable")]
    cut = np.flatnonzero(np.diff(group[order])) + 1
    return np.split(order, cut)


def shared(codes: list[int], groups: list[np.ndarray], least: int) -> dict[int, int]:
    """Words that a place shares with the one before it in its group, in text order:
    a place shares at most one word less than the place to its left."""
    before = {b: a for g in groups for a, b in zip(g[:-1].tolist(), g[1:].tolist())}
    out, last, n, end = {}, -2, 0, len(codes)
    for i in sorted(before):
        j = before[i]
        n = max(n - 1, least) if i == last + 1 else least
        while i + n < end and j + n < end and codes[i + n] == codes[j + n]:
            n += 1
        out[i], last = n, i
    return out


class Node:
    """Places of a subtree, sorted: all, and by left word."""

    __slots__ = ("all", "left")

    def __init__(self, place: int, left: int):
        self.all = [place]
        self.left = {left: [place]}


def _meet(small: Node, large: Node, depth: int, far: int, found: list) -> None:
    """Pairs between two children of a node, at most `far` apart, with different left words."""
    places, classes = large.all, large.left
    for left, own in small.left.items():
        same = classes.get(left, ())
        for p in own:
            a, b = bisect_left(places, p - far), bisect_right(places, p + far)
            want = b - a
            if want and same:
                want -= bisect_right(same, p + far) - bisect_left(same, p - far)
            if not want:
                continue
            # Places so near that share so much are a progression; an odd one stands first.
            while want:
                q = places[a]
                if not _holds(same, q):
                    found.append((min(p, q), abs(p - q), depth))
                    want -= 1
                a += 1


def _holds(places, q: int) -> bool:
    k = bisect_left(places, q)
    return k < len(places) and places[k] == q


def _into(small: list[int], large: list[int]) -> None:
    if len(small) * 8 < len(large):
        for p in small:
            insort(large, p)
    else:
        large += small
        large.sort()


def pairs(group: list[int], depths: list[int], lefts, reach) -> list[tuple[int, int, int]]:
    """Maximal pairs (first place, distance, shared words) of one group, by a bottom-up walk."""
    found: list[tuple[int, int, int]] = []

    def joined(a: Node, b: Node, depth: int) -> Node:
        small, large = (a, b) if len(a.all) < len(b.all) else (b, a)
        far = reach(depth)
        if far > 0:
            _meet(small, large, depth, far, found)
        _into(small.all, large.all)
        for left, own in small.left.items():
            if left in large.left:
                _into(own, large.left[left])
            else:
                large.left[left] = own
        return large

    open_: list[list] = []
    for i, place in enumerate(group):
        node = Node(place, lefts(place))
        depth = depths[i + 1] if i + 1 < len(group) else 0
        while open_ and open_[-1][0] > depth:
            level, earlier = open_.pop()
            node = joined(earlier, node, level)
        if open_ and open_[-1][0] == depth:
            open_[-1][1] = joined(open_[-1][1], node, depth)
        else:
            open_.append([depth, node])
    return found


def runs_of(docs: list[list[bytes]], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """For each document, its runs (start, length, period) of `least` words and `power` periods or more."""
    numbers: list[int] = []
    starts = [0]
    used = 0
    for found in docs:
        ids: dict[bytes, int] = {}
        numbers += [ids.setdefault(w, used + len(ids)) for w in found]
        used += len(ids)
        starts.append(len(numbers))
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not numbers:
        return out
    shortest = max(1, min(max(least - d, (power - 1) * d) for d in range(1, least + 1)))
    groups = repeated(np.array(numbers, np.int64), shortest)
    depth_of = shared(numbers, groups, shortest)
    first = set(starts)

    def lefts(place: int) -> int:
        return -1 if place in first else numbers[place - 1]

    def reach(depth: int) -> int:
        return depth // (power - 1)

    best: dict[tuple[int, int], int] = {}
    for group in groups:
        places = group.tolist()
        depths = [0] + [depth_of[p] for p in places[1:]]
        # No pair of the group is nearer than its nearest neighbours.
        if np.diff(np.sort(group)).min() > reach(max(depths)):
            continue
        for start, period, depth in pairs(places, depths, lefts, reach):
            if depth + period >= least:
                key = (start, start + period + depth)
                best[key] = min(best.get(key, period), period)
    ends = np.array(starts)
    for (start, end), period in best.items():
        k = int(np.searchsorted(ends, start, "right")) - 1
        out[k].append((start - starts[k], end - start, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def planted(found: list[bytes], doc_id) -> list[bytes]:
    """The words as the query takes them: in a tenth of the documents the tail repeats."""
    if doc_id is None or not found:
        return found
    h, n = crc32(str(doc_id).encode()), len(found)
    if h % 10:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + [found[a + (i - a) % p] for i in range(a, n)]


def kept_words(found: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what follows the first period of a run."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        out += found[at:a] if a > at else []
        at = max(at, b)
    return out + found[at:]


def _blocks(rows: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    block, size = [], 0
    for row in rows:
        if block and size + len(row) > BLOCK:
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row)
    yield block


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER,
                  change=None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs by start, then period, and the text
    without their repeats. `change(words, doc_id)` may replace the words first; `power` is 2 or more."""
    kind = dict(docs.dtypes)["doc_id"]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            rows = [change(words(t.as_py()), i.as_py()) if change else words(t.as_py()) for i, t in zip(ids, texts)]
            found = [r for block in _blocks(rows) for r in runs_of(block, least, power)]
            yield pa.RecordBatch.from_arrays([
                ids,
                pa.array(map(len, rows), pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], pa.list_(run)),
                pa.array([b" ".join(kept_words(w, r)).decode() for w, r in zip(rows, found)], pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])

    return small_batches(docs).selectExpr("doc_id", f"`{text}` AS text").mapInArrow(
        find, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent and digests; exponents compare as exact fractions."""
    listed = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    best = """CASE WHEN size(runs) > 0 THEN aggregate(runs, runs[0], (b, r) -> IF(r.length * b.period > b.length * r.period, r, b))
              END"""
    return found.selectExpr("*", f"{best} AS best").selectExpr(
        "doc_id", "CAST(size(runs) AS BIGINT) AS n_runs",
        "best.start AS start", "best.length AS length", "best.period AS period",
        "CAST(1000 * best.length DIV best.period AS BIGINT) AS exponent_milli",
        f"sha2({listed}, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256")


@query("op13_periodic")
def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    return digests(periodic_runs(table(spark, folder, "documents"), change=planted))
