"""Target-distribution importance resampling with hashed word features.

A table of 256 bytes makes A-Z small and turns every ASCII byte that is neither letter nor
digit into a blank; bytes beyond ASCII stay, so it works on UTF-8 as it is and `bytes.split`
gives the words. The bucket of a run of words is its crc32 modulo the number of buckets;
runs of k + 1 words take the crc32 of the run of k as seed. A Counter in every task reduces
the codes to bucket counts, and Spark adds up the tasks. The log ratio of target to corpus
is a bucket's gain; the floored mean of a text's gains is its weight, and Gumbel noise from
its doc_id turns "the highest scores" into a draw in proportion to weights.

Two scans of the texts; only numbers are sorted. Memory: one batch of texts and one array of
buckets a task, and one array on the driver; both have the size of the parameter `buckets`.

Null and empty texts have no features, weight 0, and are never drawn where `least` is above
0. A null doc_id takes the noise of an empty one and comes first among ties. Repeated rows
are documents of their own: each counts and can be drawn. An empty target has uniform
counts; an empty corpus gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import durable, query, small_batches, table
from docloom.operators.sequence import Ordered

BUCKETS, PERCENT, LEAST, SEED = 10_000, 10, 20, 2024

# Byte -> itself, its small letter, or a blank.
TABLE = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def codes(found: list[bytes], longest: int) -> Iterator[list[int]]:
    """crc32 of the runs of 1, 2, ... `longest` words, each from the code of the run one word shorter."""
    level = list(map(crc32, found))
    yield level
    for size in range(1, min(longest, len(found))):
        level = [crc32(b" " + word, seed) for seed, word in zip(level, found[size:])]
        yield level


def bucket_counts(df: DataFrame, text: str, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            tally: Counter[int] = Counter()
            for value in batch.column(0):
                for level in codes(words(value.as_py()), longest):
                    tally.update(level)
            at = np.fromiter(tally.keys(), np.int64, len(tally)) % buckets
            np.add.at(total, at, np.fromiter(tally.values(), np.int64, len(tally)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    rows = small_batches(df).select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of every bucket, with one added to each count."""
    many = len(corpus)
    over, under = (target + 1.0) * (corpus.sum() + many), (corpus + 1.0) * (target.sum() + many)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                found = words(value.as_py())
                n = total = 0
                for level in codes(found, longest):
                    n += len(level)
                    total += int(gain[np.array(level, np.int64) % len(gain)].sum())
                out.append((len(found), n, total // n if n else 0))
            numbers = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, numbers)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(
        weights, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int):
    """floor(1000 g) of a standard Gumbel value g that depends on the doc_id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = 1,
             percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Every document with its weight, score and rank in the draw (null: not drawn)."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    gain = gains(bucket_counts(docs, "text", buckets, longest), bucket_counts(target, text, buckets, longest))
    scored = durable(weigh(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed)))
    able = scored.filter(F.col("n_words") >= least)
    drawn = percent * able.count() // 100
    order = able.withColumn("_down", -F.col("score"))
    placed = Ordered(order, order=["_down", "doc_id", "n_features", "weight"]).numbered
    ranked = placed.withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1))
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("bigint"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
# crc32 of the distinct words: a table of 256 remainders, then one look-up a byte.
_SQL = f"""
WITH remainders AS (
  SELECT list(list_reduce(list_prepend(b::BIGINT, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS tab
  FROM range(256) AS r(b)),
doc_words AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents),
item_words AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT word FROM doc_words UNION SELECT word FROM item_words),
bucket_of AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM vocabulary, remainders),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN bucket_of USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM item_words JOIN bucket_of USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + {BUCKETS})
    / ((s.n::DOUBLE + 1) * (t_all + {BUCKETS}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total
  FROM doc_words JOIN bucket_of USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features,
    CASE WHEN n IS NULL THEN 0::BIGINT ELSE ((total - ((total % n) + n) % n) // n)::BIGINT END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM documents LEFT JOIN sums USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS many
  FROM scored WHERE n_features >= {LEAST})
SELECT d.doc_id, d.n_features, d.weight, (d.weight + d.noise)::BIGINT AS score,
  CASE WHEN r.place <= {PERCENT} * r.many // 100 THEN r.place::BIGINT END AS rank
FROM scored d LEFT JOIN ranked r USING (doc_id)
"""


@query("op12_resample", _SQL)
def op12_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
