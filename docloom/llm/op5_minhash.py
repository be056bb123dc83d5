"""Near-duplicates by min-max hashing.

Each hash function is evaluated once for each shingle and gives two signature values, the
minimum and the maximum, which halves the evaluations. `BANDS` bands of `ROWS` values give
candidates; every link is confirmed on the full shingle sets.

Work is done on distinct shingle sets: exact copies join the class of the smallest doc_id
by one aggregate. In each bucket, members are first compared with one pivot, in a few
rounds with other pivots; what is linked then needs no further test, since only components
are asked for. Members of buckets that still hold several components meet at the end by the
rarest shingles of their sets (prefix filter with bounds on sizes and places, which no
similar pair fails), so no link between different texts of a bucket is lost.

Null and blank texts have an empty set and are linked with nothing. A text of fewer words
than a shingle is one shingle. Rows without doc_id are documents of their own with a null
component that are kept; rows that repeat a doc_id share one component. Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import durable, query, table
from docloom.llm.components import components

SIZE, PERCENT = 5, 85
ROWS, BANDS = 10, 48
ROUNDS = 2

class Known(dict):
    """64-bit codes of the words seen so far; emptied when there are many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(text: str | None, known: Known) -> np.ndarray:
    """A code of every word; on bytes, `lower` and `split` know ASCII letters and gaps only."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_codes(text: str | None, size: int, known: Known) -> np.ndarray:
    """Sorted distinct 64-bit codes of the word shingles of a text."""
    codes = word_codes(text, known)
    if not len(codes):
        return codes
    width = min(size, len(codes))
    total = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + codes[i:len(codes) - width + 1 + i])
    return np.unique(total)


def _signature(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every hash function, each evaluated once a shingle."""
    x = (codes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(a), np.uint32)
    for start in range(0, len(x), 512):  # blocks keep a very long text within the cache
        part = x[start:start + 512]
        h = a[:, None] * part[None, :] + b[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def _band_order(values: int) -> np.ndarray:
    return np.random.default_rng(11).permutation(values)


def sign(docs: DataFrame, size: int = SIZE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit code of the whole set, and the band keys of each row."""
    half = rows * bands // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        rng = np.random.default_rng(5)
        a = rng.integers(0, 1 << 32, half, np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, half, np.uint32)
        order = _band_order(2 * half)
        known = Known()
        for pdf in batches:
            n, whole, keys = [], [], []
            for text in pdf["text"]:
                codes = shingle_codes(text, size, known)
                n.append(len(codes))
                if not len(codes):
                    whole.append(None)
                    keys.append(None)
                    continue
                whole.append(xxhash.xxh3_128_digest(codes.tobytes()))
                picked = _signature(codes, a, b)[order].reshape(bands, rows)
                key = np.arange(bands, dtype=np.uint64)
                for j in range(rows):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + picked[:, j])
                keys.append(key.view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": n,
                                "whole": whole, "keys": keys})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_shingles long, whole binary, keys array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(both * 100 >= (F.size("x") + F.size("y") - both) * percent)
            .select("a", "b"))


def _prefix_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of `rows` (id, n, component) in different components that may be similar.

    With the shingles of every set in one order, rarest first, two similar sets share one
    of their first `n - ceil(n * percent / 100) + 1` shingles, and at the first shared one
    enough of both sets is still to come. Both are necessary, so no similar pair is lost.
    """
    tokens = (sets.join(rows.select("id"), "id", "left_semi")
              .select("id", F.explode("shingles").alias("token")))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    head = (tokens.join(common, "token", "left")
            .select("id", "token", F.coalesce("df", F.lit(1)).alias("df"))
            .withColumn("place", place).join(rows, "id")
            .filter(F.expr(f"place * 100 <= n * {100 - percent} + 100"))
            .filter("df > 1"))
    head = durable(head.select("id", "token", "n", "component", (F.col("n") - F.col("place") + 1).alias("left")))
    other = head.select("token", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "component", "left")])
    most = "least(left, p_left)"
    return (head.join(other, "token")
            .filter("id < p_id AND component != p_component")
            .filter(F.expr(f"{most} * 100 >= (n + p_n - {most}) * {percent}"))
            .select(F.col("id").alias("a"), F.col("p_id").alias("b")).distinct())


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT,
                    rows: int = ROWS, bands: int = BANDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row."""
    signed = durable(sign(docs, size, rows, bands))
    classes = (signed.filter("whole IS NOT NULL AND doc_id IS NOT NULL").groupBy("whole")
               .agg(F.min("doc_id").alias("id"), F.min_by("keys", "doc_id").alias("keys"),
                    F.first("n_shingles").alias("n")))
    classes = durable(classes)
    # A doc_id on several rows with different texts ties their classes together.
    member = signed.filter("whole IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "whole")
    ties = (member.join(classes.select("whole", "id"), "whole")
            .filter("doc_id != id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")))
    banded = classes.select("id", "n", F.posexplode("keys").alias("band", "key")) \
        .select("id", "n", F.xxhash64("band", "key").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")) \
        .filter("low < high").select("key")
    # Rows of buckets with two or more different sets; the rest can have no link.
    banded = durable(banded.join(shared, "key"))
    wanted = banded.select(F.col("id").alias("doc_id")).distinct()
    sets = durable(_sets(docs.join(wanted, "doc_id", "left_semi"), size))
    links = None
    label = banded.select("id", F.col("id").alias("component")).distinct()
    fits = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent
    for turn in range(rounds):
        now = banded.join(label, "id")
        pivot = now.groupBy("key").agg(
            F.min_by(F.struct("id", "n", "component"), F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.col("id"), "id")).alias("p"))
        pairs = (now.join(pivot, "key")
                 .select("id", "n", "component", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"),
                         F.col("p.component").alias("pc"))
                 .filter("component != pc").filter(fits)
                 .select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b"))
                 .distinct())
        found = durable(_confirmed(pairs, sets, percent))
        links = found if links is None else links.unionByName(found)
        parts = durable(components(links))
        label = (banded.select("id").distinct().join(parts, "id", "left")
                 .select("id", F.coalesce("component", "id").alias("component")))
        label = durable(label)
    # What is left: members of one bucket in different components, whatever the pivot.
    now = banded.join(label, "id")
    open_keys = (now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .filter("low < high").select("key"))
    rest = durable(now.join(open_keys, "key").select("id", "n", "component").distinct())
    pairs = _prefix_pairs(rest, sets, percent)
    links = links.unionByName(_confirmed(pairs, sets, percent)).unionByName(ties)
    parts = durable(components(links))
    found = (member.join(classes.select("whole", "id"), "whole").groupBy("doc_id")
             .agg(F.min("id").alias("id")).join(parts, "id", "left")
             .select("doc_id", F.coalesce("component", "id").alias("component_id")))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known()
        for pdf in batches:
            yield pd.DataFrame({
                "id": pdf["doc_id"], "shingles": [shingle_codes(t, size, known).view(np.int64)
                                                  for t in pdf["text"]]})

    rows = docs.select("doc_id", "text").mapInPandas(run, "id long, shingles array<long>")
    # Repeated ids hold the union of their texts' sets only through `ties`; one row serves a pair.
    return rows.dropDuplicates(["id"])


@query("op5_minhash")
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
