"""Fuzzy repeated passages by collinear chaining of shared seeds.

Seeds are runs of `SEED` words; of every `SPAN` neighbouring ones the least code is taken,
so equal stretches of SEED + SPAN - 1 words share a seed. A seed's smallest document is its
source; each other document that has the seed is joined to the source, never to all others.
Seeds that no passage with a source then explains have a second way: documents that share two
of them, as far apart as the ends of a chain, are joined to each other by all seeds they share.
Where more than `FEW` documents share two seeds, only those are joined that share a word as well:
of every document so many words are picked, rare ones of the group first, that no passage of it
can do without all of them, so no pair that holds a passage is left out.
The shared seeds of a pair are chained in order: the best chain that ends at a seed is the
best one before it in both texts less a cost for the gap, found by a Fenwick tree over the
source places. Chains are cut out best first, and the word stretches of each chain are
aligned from exact runs, with a best alignment between them. A chain may reach over unshared
words, so every part of it is tried: the longest part of at least `WORDS` words with
`IDENTITY` of them equal is a passage, then the longest on either side of it, and so on.
`n_seeds` counts the seeds of the whole chain.

The seed counts are combined before the shuffle and the join's source side has one row a
seed, so a passage held by a third of the documents is split by the adaptive join. A seed
that a text repeats counts at its first place. The second way still grows faster than the input
where documents that share unexplained seeds, such as a notice shorter than a passage, share their
picked words too; its joins spill and are split, and nothing is left out. Null, empty and short texts have no passages;
rows without doc_id are not compared; of rows that repeat a doc_id the longest text is used.
Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import maybe_in, query, small_batches, table, written
from docloom.llm.op5_minhash import Known, _mix, word_codes
from docloom.session import remove

SEED, SPAN = 6, 10
WORDS, IDENTITY = 50, 0.8
MATCH, GAP = 6.0, 0.1


# Words whose seeds are made at once.
BLOCK = 1 << 17


def seeds(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, place) of the chosen seeds of texts of `WORDS` words at least, each code at its first place."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    words = np.concatenate(texts)
    n = len(words) - SEED + 1
    total = np.zeros(n, np.uint64)
    for i in range(SEED):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n])
    least, width = total, 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    # Stretches that reach into the next text have no least code.
    across = (ends[:-1, None] - np.arange(1, SEED + SPAN - 1)).ravel()
    inside = np.ones(len(least), bool)
    inside[across] = False
    # A seed is chosen where it is the least of some stretch that holds it, of equal ones the first.
    edge = np.zeros(SPAN - 1, np.uint64)
    most = np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge])
    some = np.concatenate([[0], np.cumsum(np.concatenate([edge, inside, edge]).astype(np.int64))])
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        most, width = np.maximum(most[:-step], most[step:]), width + step
    at = np.flatnonzero((total == most) & (some[SPAN:] > some[:-SPAN]))
    text = np.searchsorted(ends, at, "right")
    order = np.lexsort((total[at], text))  # stable: places of a code stay in order
    at, text = at[order], text[order]
    code = total[at]
    first = np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])
    return text[first], code[first], (at - (ends - sizes)[text])[first]


def _seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Known()

    def rows(docs: list[int], texts: list[np.ndarray]) -> pd.DataFrame:
        text, code, place = seeds(texts)
        return pd.DataFrame({"code": code.view(np.int64), "doc_id": np.array(docs, np.int64)[text],
                             "place": place.astype(np.int32)})

    for pdf in batches:
        docs, texts, size = [], [], 0
        for d, text in zip(pdf["doc_id"], pdf["text"]):
            words = word_codes(text, known)
            # A passage has at least WORDS words on both sides.
            if len(words) < WORDS:
                continue
            docs.append(d)
            texts.append(words)
            size += len(words)
            if size >= BLOCK:
                yield rows(docs, texts)
                docs, texts, size = [], [], 0
        if docs:
            yield rows(docs, texts)


def chains(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(first x, last x, first y, last y, seeds) of ordered chains, the heaviest first.

    score(j) = MATCH + max(0, max over i before j in x and y of score(i) - GAP * gap(i, j))
    with gap = (x_j - x_i) + (y_j - y_i), a maximum of score(i) + GAP * (x_i + y_i) over a prefix.
    """
    order = np.lexsort((-y, x))
    x, y = x[order], y[order]
    levels = {v: i + 1 for i, v in enumerate(np.unique(y).tolist())}
    n, size = len(x), len(levels)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    xs, ys = x.tolist(), y.tolist()
    waiting: list[tuple[int, tuple[float, int]]] = []
    for j in range(n):
        if j and xs[j] != xs[j - 1]:
            for at, value in waiting:  # places with the same x never follow each other
                while at <= size:
                    if tree[at] < value:
                        tree[at] = value
                    at += at & -at
            waiting = []
        at, best = levels[ys[j]] - 1, (-1e18, -1)
        while at > 0:
            best = max(best, tree[at])
            at -= at & -at
        here = GAP * (xs[j] + ys[j])
        gain = best[0] - here
        score[j] = MATCH + max(0.0, gain)
        if gain > 0:
            back[j] = best[1]
        waiting.append((levels[ys[j]], (score[j] + here, j)))
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: (-score[j], j)):
        if used[j]:
            continue
        last, first, count, i = j, j, 0, j
        while i >= 0 and not used[i]:
            used[i], first, count, i = True, i, count + 1, back[i]
        out.append((xs[first], xs[last], ys[first], ys[last], count))
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common subsequence of `a` with every beginning of `b`."""
    row = np.zeros(len(b) + 1, np.int32)
    for word in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == word))
        np.maximum.accumulate(row, out=row)
    return row


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; wide tables are halved, so memory stays small."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n * m > 1 << 22 and n > 1:
        half = n // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _common(a[half:], b[cut:])]
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        table[i + 1, 1:] = np.maximum(table[i, 1:], table[i, :-1] + (b == a[i]))
        np.maximum.accumulate(table[i + 1], out=table[i + 1])
    out, i, j = [], n, m
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _anchors(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places in order of runs of `SEED` words that either stretch holds once."""
    n, m = len(x) - SEED + 1, len(y) - SEED + 1
    if n < 1 or m < 1:
        return []
    once = []
    for words, size in ((x, n), (y, m)):
        total = np.zeros(size, np.uint64)
        for i in range(SEED):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + words[i:i + size])
        code, first, count = np.unique(total, return_index=True, return_counts=True)
        once.append((code[count == 1], first[count == 1]))
    _, p, q = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    p, q = once[0][1][p], once[1][1][q]
    order = np.argsort(p)
    rising = bool((np.diff(q[order]) > 0).all())
    p, q = p[order].tolist(), q[order].tolist()
    if rising:
        return list(zip(p, q))
    # The longest rising row of the second places.
    ends: list[int] = []
    tails: list[int] = []
    back = [-1] * len(q)
    for k, v in enumerate(q):
        at = bisect_left(ends, v)
        back[k] = tails[at - 1] if at else -1
        ends[at:at + 1], tails[at:at + 1] = [v], [k]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append((p[k], q[k]))
        k = back[k]
    return out[::-1]


def _run(x: np.ndarray, y: np.ndarray) -> int:
    """Number of equal words that two stretches begin with."""
    n, step = min(len(x), len(y)), 32
    at = 0
    while at < n:
        odd = x[at:min(at + step, n)] != y[at:min(at + step, n)]
        if odd.any():
            return at + int(odd.argmax())
        at, step = at + step, 2 * step
    return n


def aligned(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal words in both stretches, in order: exact runs at anchors, best alignments between."""
    out: list[np.ndarray] = []
    i = j = 0
    for p, q in [*_anchors(x, y), (len(x), len(y))]:
        if p < i or q < j:  # within the run of the anchor before, or across it
            continue
        a, b = i, j
        if p < len(x):
            back = _run(x[a:p][::-1], y[b:q][::-1])
            p, q = p - back, q - back
        between = _common(x[a:p], y[b:q])
        if between:
            out.append(np.array(between, np.int64) + (a, b))
        n = _run(x[p:], y[q:])
        if n:
            out.append(np.arange(n)[:, None] + (p, q))
        i, j = p + n, q + n
    both = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def parts(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the stretches of aligned places that are passages, the longest taken first.

    Equal words n of a stretch reach the identity if n - IDENTITY * length >= 0 on both sides;
    the terms of its two ends are apart, so all stretches of n equal words are tried at once.
    """
    k = np.arange(len(x))
    low, high = [k - IDENTITY * v for v in (x, y)], [k + 1 - IDENTITY * (v + 1) + 1e-9 for v in (x, y)]
    out, todo = [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        # No passage crosses more unequal words than all equal words of the range allow.
        wide = np.flatnonzero(np.maximum(np.diff(x[a:b]), np.diff(y[a:b])) - 1
                              > (b - a) * (1 - IDENTITY) / IDENTITY + 1e-9)
        if len(wide):
            edges = [a, *(a + 1 + wide).tolist(), b]
            todo += zip(edges, edges[1:])
            continue
        for n in range(b - a, math.ceil(IDENTITY * WORDS - 1e-9) - 1, -1):
            p, q = slice(a, b - n + 1), slice(a + n - 1, b)
            fit = ((high[0][q] >= low[0][p]) & (high[1][q] >= low[1][p])
                   & (np.minimum(x[q] - x[p], y[q] - y[p]) + 1 >= WORDS))
            if fit.any():
                at = a + int(fit.argmax())
                out.append((at, at + n - 1))
                todo += [(a, at), (at + n, b)]
                break
    return sorted(out)


_SPANS = "array<struct<a:int, b:int, c:int, d:int, seeds:int>>"


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, source, matches in zip(pdf["doc_id"], pdf["source"], pdf["matches"]):
            x = np.array([m["x"] for m in matches])
            y = np.array([m["y"] for m in matches])
            for a, b, c, d, k in chains(x, y):
                if k >= 2 and min(b - a, d - c) + SEED >= WORDS // 2:
                    out.append((doc, source, a, b + SEED, c, d + SEED, k))
        yield pd.DataFrame(out, columns=["doc_id", "source", "a", "b", "c", "d", "seeds"])


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Known()
    for pdf in batches:
        rows = []
        for text, spans in zip(pdf["text"], pdf["spans"]):
            codes = word_codes(text, known)
            for s in spans:
                # A few words more on either side: the ends of a passage lie beyond its outer seeds.
                low, high = max(0, s["low"] - SPAN), min(len(codes), s["high"] + SPAN)
                rows.append((s["key"], s["side"], low, codes[low:high].tobytes()))
        yield pd.DataFrame(rows, columns=["key", "side", "at", "words"])


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, source, n, at, words, source_at, source_words in zip(*(pdf[c] for c in (
                "doc_id", "source", "seeds", "x_at", "x_words", "y_at", "y_words"))):
            x, y = aligned(np.frombuffer(words, np.uint64), np.frombuffer(source_words, np.uint64))
            for p, q in parts(x, y):
                a, b, c, d = int(x[p]), int(x[q]) + 1, int(y[p]), int(y[q]) + 1
                out.append((doc, source, at + a, at + b, source_at + c, source_at + d, n,
                            (q - p + 1) / max(b - a, d - c)))
        yield pd.DataFrame(out, columns=["doc_id", "source_id", "start", "end", "source_start",
                                         "source_end", "n_seeds", "identity"])


# The words of all chains of a round are at most this part of the words of the corpus, so that texts which
# mostly repeat others do not lie on the disk several times over.
PART = 0.5


def _compared(docs: DataFrame, matches: DataFrame, size: int) -> DataFrame:
    """The passages of pairs of documents, from the places (doc_id, source, x, y) of their shared seeds.

    `size` is about the number of words of the corpus.
    """
    matches = matches.groupBy("doc_id", "source").agg(F.collect_set(F.struct("x", "y")).alias("matches")).filter(
        F.size("matches") >= 2)
    found = matches.mapInPandas(_chained, "doc_id long, source long, a int, b int, c int, d int, seeds int")
    found = written(found.withColumn("key", F.xxhash64("doc_id", "source", "a", "b", "c", "d")).dropDuplicates(
        ["doc_id", "source", "a", "b", "c", "d"]))

    def side(found: DataFrame, who: str, low: str, high: str, n: int) -> DataFrame:
        return found.select(F.col(who).alias("doc_id"), F.struct(
            "key", F.lit(n).alias("side"), F.col(low).alias("low"), F.col(high).alias("high")).alias("span"))

    def passages_of(found: DataFrame) -> DataFrame:
        # The words of both sides of every chain, from one pass over the texts; a source of very many chains is cut in blocks.
        spans = side(found, "doc_id", "a", "b", 0).unionByName(side(found, "source", "c", "d", 1))
        texts = _longest(docs, spans)
        spans = spans.groupBy("doc_id", F.pmod("span.key", F.lit(64)).alias("block")).agg(F.collect_list("span").alias("spans"))
        words = spans.join(texts, "doc_id").mapInPandas(_slices, "key long, side int, at int, words binary")
        words = words.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("side", "at", "words"))).alias("s")).select(
            "key", F.col("s")[0]["at"].alias("x_at"), F.col("s")[0]["words"].alias("x_words"),
            F.col("s")[1]["at"].alias("y_at"), F.col("s")[1]["words"].alias("y_words"))
        both = found.select("key", "doc_id", "source", "seeds").join(words, "key")
        return both.mapInPandas(_aligned, "doc_id long, source_id long, start int, end int, source_start int,"
                                          " source_end int, n_seeds int, identity double")

    # Rounds by document, so that only the texts of sources are read in several of them.
    sliced = found.agg(F.sum(F.expr(f"b - a + d - c + {4 * SPAN}"))).first()[0] or 0
    rounds = max(1, math.ceil(sliced / (PART * max(size, 1))))
    out = written(*(passages_of(found.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)) for k in range(rounds)))
    remove(found)
    return out


# A chain's words and SPAN on either side hold a passage, so its outer seeds are this far apart at least. The
# first seed that far from a chain's first one is looked for within 100 words more.
LEAST = WORDS - SEED - 2 * SPAN
MOST = LEAST + 100


def _ends(rows: DataFrame) -> DataFrame:
    """(doc_id, one, two): pairs of seeds of a text that stand LEAST to MOST words apart, in order."""
    places = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("place", "code"))).alias("s"))
    each = places.select("doc_id", "s", F.posexplode("s").alias("i", "p"))
    after = F.filter(F.slice("s", F.col("i") + 2, F.lit(MOST)), lambda q: (q["place"] - F.col("p.place")).between(LEAST, MOST))
    return each.select("doc_id", F.col("p.code").alias("one"), F.explode(after).alias("q")).select(
        "doc_id", "one", F.col("q.code").alias("two"))


# Documents of a seed pair that are all compared; where more have it, one of the words of `picks` must be shared as well.
FEW = 4


def picks(cost: np.ndarray) -> np.ndarray:
    """Places of a text, cheap ones if possible, one of which every passage of the text has as an equal word.

    A passage begins and ends with equal words, and so do the rows of 50 words or a little more that it can be cut
    into; one of these reaches the identity. So every stretch of that length needs one chosen place more than it may
    have unequal words, or a chosen place at an end: what is left of it is then no passage.
    """
    chosen = cost == 0
    for size in range(WORDS, min(int(2 * WORDS / IDENTITY), len(cost)) + 1):
        need = int(size * (1 - IDENTITY) + 1e-9) + 1
        total = np.concatenate([[0], np.cumsum(chosen)])
        short = (total[size:] - total[:-size] < need) & ~chosen[:len(cost) - size + 1] & ~chosen[size - 1:]
        for at in np.flatnonzero(short).tolist():
            here = chosen[at:at + size]
            lack = need - int(here.sum())
            if lack <= 0 or here[0] or here[-1]:
                continue
            # Of equal costs the last one, which more of the next stretches hold.
            for k in size - 1 - np.argsort(cost[at:at + size][::-1], kind="stable"):
                if lack <= 0 or here[0] or here[-1]:
                    break
                lack -= not here[k]
                here[k] = True
    return np.flatnonzero(chosen)


def _said(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Known()
    for pdf in batches:
        said = [np.unique(word_codes(text, known)) for text in pdf["text"]]
        if said:
            yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(np.int64), [len(s) for s in said]),
                                "word": np.concatenate(said).view(np.int64)})


def _picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Known()
    for pdf in batches:
        for doc, text, words, costs in zip(pdf["doc_id"], pdf["text"], pdf["words"], pdf["costs"]):
            codes = word_codes(text, known)
            # A word that no other document of its groups has is equal to none, and costs nothing.
            word = np.asarray(words, np.int64).view(np.uint64)
            order = np.argsort(word)
            word, price = word[order], np.asarray(costs, np.int64)[order]
            at = np.minimum(np.searchsorted(word, codes), len(word) - 1)
            cost = np.where(word[at] == codes, price[at], 0)
            at = picks(cost)
            code = np.unique(codes[at[cost[at] > 0]])
            yield pd.DataFrame({"doc_id": np.full(len(code), doc, np.int64), "word": code.view(np.int64)})


def _longest(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents of `ids`; of rows that repeat a doc_id the longest text."""
    return maybe_in(docs, ids, "doc_id").join(ids.select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(
        F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))


def _worded(texts: DataFrame, mine: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (doc_id, source) of a pair of seeds that may hold a passage, told by one of the words of `picks`."""
    # Pairs of seeds of the same documents are one group.
    code = F.xxhash64("source").cast("decimal(20,0)")
    same = written(others.groupBy("one", "two").agg(F.count("*").alias("n"), F.sum(code).alias("s"), F.sum(
        F.xxhash64("source", F.lit(1)).cast("decimal(20,0)")).alias("t")).select("one", "two", F.struct("n", "s", "t").alias("g")))
    # Groups travel by a number that is certain: a group has one least pair of seeds.
    least = same.groupBy("g").agg(F.min(F.struct("one", "two")).alias("least"))
    named = written(same.join(least, "g").select("one", "two", F.col("least").alias("g")))
    remove(same)
    others = written(others.join(named, ["one", "two"]).select("g", "source").distinct())
    mine = written(mine.join(named, ["one", "two"]).select("g", "doc_id").distinct())
    remove(named)

    said = written(texts.join(mine.select("doc_id").union(others.select("source")).distinct(), "doc_id", "left_semi").mapInPandas(
        _said, "doc_id long, word long"))
    held = written(others.join(said.withColumnRenamed("doc_id", "source"), "source").select("g", "word", "source"))
    # A word costs the other documents that it would lead to.
    own = mine.join(others.select("g", F.col("source").alias("doc_id"), F.lit(1).alias("own")), ["g", "doc_id"], "left")
    cost = (own.join(said, "doc_id").join(held.groupBy("g", "word").agg(F.count("*").alias("n")), ["g", "word"])
            .groupBy("doc_id", "word").agg(F.sum(F.col("n") - F.coalesce("own", F.lit(0))).alias("cost")).filter("cost > 0"))
    cost = cost.groupBy("doc_id").agg(F.collect_list(F.struct("word", "cost")).alias("s")).select(
        "doc_id", F.col("s.word").alias("words"), F.col("s.cost").alias("costs"))
    picked = written(cost.join(maybe_in(texts, mine, "doc_id"), "doc_id").mapInPandas(_picked, "doc_id long, word long"))
    asked = written(mine.join(picked, "doc_id"))
    out = written(asked.join(maybe_in(held, asked, "g", "word"), ["g", "word"])
                  .filter("doc_id > source").select("doc_id", "source").distinct())
    for done in (others, mine, said, held, picked, asked):
        remove(done)
    return out


def _left(shared: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, one, two), the ends of chains which no found passage of the document holds; all that have them as sources."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    held = F.exists("spans", lambda s: (F.col("place") >= s["start"]) & (F.col("place") + SEED <= s["end"]))
    rest = written(shared.filter("doc_id > source").join(spans, "doc_id", "left").filter(
        ~F.coalesce(held, F.lit(False))).select("code", "doc_id", "place"))
    mine = written(_ends(rest))
    others = maybe_in(shared, rest, "code").join(rest.select("code").distinct(), "code")
    others = _ends(others).withColumnRenamed("doc_id", "source")
    others = written(others.join(mine.select("one", "two").distinct(), ["one", "two"], "left_semi"))
    remove(rest)
    return mine, others


def _unexplained(texts: DataFrame, mine: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (doc_id, source) that share the ends of a chain which no found passage of the document holds.

    Of a pair of seeds that many documents have, only documents that can hold a passage are paired.
    """
    many = written(others.groupBy("one", "two").agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select("one", "two"))
    few = (mine.join(many, ["one", "two"], "left_anti").join(others.join(many, ["one", "two"], "left_anti"), ["one", "two"])
           .filter("doc_id > source").select("doc_id", "source"))
    worded = _worded(texts, mine.join(many, ["one", "two"], "left_semi"), others.join(many, ["one", "two"], "left_semi"))
    pairs = written(few.union(worded).distinct())
    remove(many)
    remove(worded)
    return pairs


# The seeds are joined to their sources in so many rounds, whose shuffle files do not lie on the disk together.
ROUNDS = 4


def passages(docs: DataFrame) -> DataFrame:
    """One row for each passage of a document that a source document also has."""
    docs = small_batches(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    rows = written(docs.mapInPandas(_seed_rows, "code long, doc_id long, place int"))
    # Of neighbouring stretches of SPAN seeds, two in SPAN + 1 have another least one.
    size = rows.count() * (SPAN + 1) // 2

    def part(df: DataFrame, k: int) -> DataFrame:
        return df.filter(F.pmod("code", F.lit(ROUNDS)) == k)

    sources = written(*(part(rows, k).groupBy("code").agg(F.min(F.struct("doc_id", "place")).alias("s"), F.max("doc_id").alias("most"))
                        .filter("s.doc_id < most").select("code", F.col("s.doc_id").alias("source"), F.col("s.place").alias("y"))
                        for k in range(ROUNDS)))
    shared = written(*(maybe_in(part(rows, k), part(sources, k), "code").join(part(sources, k), "code") for k in range(ROUNDS)))
    remove(rows)
    remove(sources)
    found = _compared(docs, shared.filter("doc_id > source").select("doc_id", "source", F.col("place").alias("x"), "y"), size)

    mine, others = _left(shared, found)
    texts = written(_longest(docs, mine.select("doc_id").union(others.select("source"))))
    pairs = _unexplained(texts, mine, others)
    left = maybe_in(shared.select("doc_id", "code", F.col("place").alias("x")), pairs, "doc_id")
    right = maybe_in(shared.select(F.col("doc_id").alias("source"), "code", F.col("place").alias("y")), pairs, "source")
    more = _compared(texts, pairs.join(left, "doc_id").join(right, ["source", "code"]).select("doc_id", "source", "x", "y"), size)
    for done in (mine, others, shared, texts):
        remove(done)
    # A pair that is compared again is compared by more seeds.
    return found.join(pairs.withColumnRenamed("source", "source_id"), ["doc_id", "source_id"], "left_anti").select(
        *more.columns).unionByName(more)


@query("op1_chaining")
def op1_chaining(spark: SparkSession, folder: str) -> DataFrame:
    return passages(table(spark, folder, "documents"))
