"""A training-data pipeline over `documents`: five stages, each one operator of docloom.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept.

1. toxicity: rows whose clause score reaches the threshold go.
2. near_dedup: of each group of near copies the document with the smallest doc_id stays.
   Documents without doc_id, and rows that repeat the doc_id of a kept one, stay.
3. decontaminate: documents that contain a window of a benchmark item go.
4. pii: validated personal numbers, dates, addresses and secrets become pseudonyms, and
   n_chars follows the new text.
5. tokens: every text is encoded and decoded; one row of counts and digests for each.

Null and empty texts pass all stages (they score as clean, have no copies and no hits);
an empty table gives an empty result. Columns beyond those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import op2_toxicity, op3_decontaminate, op5_minhash, op7_bpe, op9_pii
from docloom.llm.common import durable, table

# Near copies share 80 % of their five-word shingles; these bands miss such a pair in 2 of 100,000 cases.
PERCENT, ROWS, BANDS = 80, 8, 60
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op2_toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = op2_toxicity.score(docs, model)
    return scored.filter(F.col("toxicity.score") < op2_toxicity.THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = op5_minhash.near_duplicates(docs, percent=PERCENT, rows=ROWS, bands=BANDS).filter("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A document is known by its id and text here, so that rows without id are judged too.
    key = F.struct("doc_id", F.xxhash64("text").alias("code"))
    found = op3_decontaminate.report(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = found.filter("contaminated").select(
        F.col("doc_id.doc_id").alias("hit_id"), F.col("doc_id.code").alias("hit_code")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_code"))
    return docs.join(hit, same, "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fresh = op9_pii.pseudonymise(docs.select(*COLUMNS))
    return fresh.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_bpe.digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("tokens", tokens),
]

# The learnt grammar, the pseudonyms and the tokens have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
