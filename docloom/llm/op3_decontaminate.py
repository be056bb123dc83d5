"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is `WINDOW` consecutive words of an item (all its words if it has fewer). For full
containment one word of a window is a necessary prefix: its rarest. Words are ordered by
how often they occur in the documents (then in the alphabet); each window is indexed under
its rarest word and that word's place in it. A document word joins the windows indexed
under it; the length and place bounds say where the window must begin and end in the
document, and equality of the whole word slice verifies the match.

Only words that are some window's rarest leave a document, each with the few words around
it, so neither texts nor all words are shuffled. The index has one row for each distinct
window; it is broadcast when it has at most `SMALL` rows, and otherwise joined by its key.

Null and empty texts have no words and no hits; items without words are never found. Items
with the same item_id count as one item in n_items. Every input row gives one output row,
also when doc_id is null or repeated. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import lower_ascii, query, table, words

WINDOW = 10
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SMALL = 50_000


def item_words(text: Column) -> Column:
    return words(lower_ascii(text), GAP)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window) of every window."""
    w = items.select("item_id", item_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (w.select("item_id", "w", F.explode(starts).alias("s"))
            .select("item_id", F.slice("w", F.col("s"), size).alias("window")).distinct())


def index(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, place, window, items): each distinct window under its rarest word."""
    grouped = found.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    ranked = (grouped.select("window", "items", F.posexplode("window").alias("place", "word"))
              .join(counts, "word", "left")
              .groupBy("window").agg(F.first("items").alias("items"), F.min(F.struct(
                  F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("r")))
    return ranked.select(F.col("r.word").alias("key"), F.col("r.place").alias("place"), "window", "items")


def word_counts(docs: DataFrame, wanted: list[str] | None, found: DataFrame) -> DataFrame:
    """How often the words of windows occur in all documents."""
    w = item_words(F.col("text"))
    if wanted is not None:
        known = F.array_distinct(F.filter(w, lambda x: x.isin(wanted)))
        return docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = found.select(F.explode("window").alias("word")).distinct()
    return (docs.select(F.explode(w).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            .join(vocabulary, "word", "left_semi"))


def _few(df: DataFrame, column: str, most: int) -> list[str] | None:
    """The values of a column if they are few, else None; at most most + 1 reach the driver."""
    rows = df.select(column).distinct().limit(most + 1).collect()
    return [r[0] for r in rows] if len(rows) <= most else None


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW,
                  small: int = SMALL) -> DataFrame:
    """One row for each document with its hits, and the items that have occurring windows."""
    found = windows(items, size)
    vocabulary = _few(found.select(F.explode("window").alias("word")), "word", small)
    ranked = index(found, word_counts(docs, vocabulary, found)).persist()
    keys = _few(ranked, "key", small)
    counted = (docs.select("doc_id", item_words(F.col("text")).alias("w"))
               .select(F.monotonically_increasing_id().alias("row"), "doc_id", "w",
                       F.size("w").cast("bigint").alias("n_words")))
    places = F.transform("w", lambda x, i: F.when(x.isin(keys) if keys is not None else F.lit(True), i))
    spots = F.filter(places, lambda i: i.isNotNull())
    around = F.transform(spots, lambda i: F.struct(
        i.alias("at"), F.element_at("w", i + 1).alias("key"), F.least(i, F.lit(size - 1)).alias("before"),
        F.slice("w", F.greatest(i - size + 2, F.lit(1)), F.least(i, F.lit(size - 1)) + size).alias("near")))
    rows = (counted.select("row", "doc_id", "n_words", around.alias("spots"))
            .select("row", "doc_id", "n_words", F.explode_outer("spots").alias("spot"))
            .select("row", "doc_id", "n_words", "spot.*"))
    small_index = keys is not None and len(ranked.limit(small + 1).select("place").collect()) <= small
    hit = (F.col("before") >= F.col("place")) & (
        F.slice("near", F.col("before") - F.col("place") + 1, F.size("window")) == F.col("window"))
    joined = rows.join(F.broadcast(ranked) if small_index else ranked,
                       (rows["key"] == ranked["key"]) & hit, "left")
    span = F.when(F.col("window").isNotNull(), F.struct(
        (F.col("at") - F.col("place")).alias("a"),
        (F.col("at") - F.col("place") + F.size("window")).alias("b")))
    return (joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")))


def covered(spans: Column) -> Column:
    """Number of places in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"].cast("bigint"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return (found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"),
                         F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, len(v) AS n, array_to_string(v, ' ') AS v FROM (
        SELECT item_id, w[s:s + 9] AS v FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(s)
        WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS v
       FROM d, sizes, unnest(range(1, len(w) - n + 2)) u(s)),
m AS (SELECT doc_id, s, iw.n, item_id FROM dw JOIN iw USING (n, v)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + n)) u(p) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@query("op3_decontaminate", SQL)
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
