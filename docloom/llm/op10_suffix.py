"""Exact substring removal by grouping winnowed fingerprints, in place of prefix doubling.

This is not distributed prefix doubling: no rank that Spark sorted is carried to a later
round. Doubling is only used within a Python task, to hash the bytes that follow a position.
Spark groups those codes in four rounds: 20-byte codes of picked positions, sums of 50-byte
codes over runs of positions, 40-byte codes around the picks, and 50-byte codes of single positions; what no other document
shares drops out between rounds.

The first round is sparse. Of the 31 positions at which a 20-byte piece of a 50-byte string
can begin, the one with the least code is taken, so two equal strings pick the same one and
about a sixteenth of all positions is sorted. A picked position stands for the run of
strings that pick it. The second round ranks whole runs of shared picks: a run that occurs
in a smaller document goes as a whole. Of the others the third round ranks 40-byte pieces
around the pick, one for each third of the run, which all strings of that third contain:
what shares no such piece is unique. Only the rest is left for the fourth round, which
ranks single 50-byte strings. A rank is a 64-bit code of the bytes; two strings
of a table of n ranked ones get the same by chance with n * n / 2^65.

Exact copies of a text are settled by one aggregate before. Within a batch of documents a
rank is sent once, by its smallest document; the others are known to be shared and travel
under keys of their own, so a passage that a third of all documents hold does not meet in
one task.

Null and short texts lose nothing. Rows without doc_id neither lose bytes nor count as
smaller. Rows that repeat a doc_id are judged each; neither is smaller than the other.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import durable, query, small_batches, table

LENGTH, SHORT = 50, 20
# Parts of a run whose strings share a piece, and by how much that is shorter than a string.
PARTS = 3
STEP = (LENGTH - SHORT) // PARTS
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixed in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _pair(x: np.ndarray, y: np.ndarray, salt: np.uint64) -> np.ndarray:
    # The parts are mixed codes already, so their weighted sum is mixed once.
    out = x * salt
    out += y
    return _mix(out)


def ranks(data: np.ndarray, length: int, salt: np.uint64) -> np.ndarray:
    """Code of the `length` bytes from every position, by doubling."""
    out, have = _mix((data.astype(np.uint64) + np.uint64(1)) * salt), 1
    while have < length:
        step = min(have, length - have)
        out = _pair(out[:len(out) - step], out[step:], salt)
        have += step
    return out


def picks(codes: np.ndarray, span: int) -> np.ndarray:
    """For each start, the position of the least code (by its upper half) among `span`, the first such.

    Upper half and position share one number, so a sliding minimum gives both.
    """
    half = np.uint64(32)
    low, have = (codes >> half << half) | np.arange(len(codes), dtype=np.uint64), 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pick, its code, first start, last start) of every run of starts with one pick."""
    codes = ranks(data, SHORT, _A)
    chosen = picks(codes, LENGTH - SHORT + 1)
    begin = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(begin[1:], len(chosen)) - 1
    at = chosen[begin]
    return at, codes[at], begin, last


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _once(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row is of the smallest document of its key, key is shared) within a batch."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(new) - 1
    low = d[np.flatnonzero(new)][group]
    high = d[np.append(np.flatnonzero(new)[1:], len(d)) - 1][group]
    smallest, shared = np.empty(len(d), bool), np.empty(len(d), bool)
    smallest[order], shared[order] = d == low, low < high
    return smallest, shared


_ROW = "code long, row long, doc_id long, a int, b int, low boolean, known boolean"


def _frame(keys, row, doc, a, b) -> pd.DataFrame:
    """Rows to sort. Those of a key's larger documents are settled here and get keys of their own."""
    low, shared = _once(keys, doc)
    keys = keys.copy()
    keys[~low] = _mix(row[~low].astype(np.uint64) * _B + a[~low].astype(np.uint64))
    return pd.DataFrame({"code": keys.view(np.int64), "row": row, "doc_id": doc, "a": a, "b": b,
                         "low": low, "known": shared})


def _first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes of the picked positions. The first start of a pick's run and its last one are at most
    30 away, and b holds the two distances."""
    for pdf in batches:
        found = []
        for row, doc, text in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
            data = _bytes(text)
            if len(data) >= LENGTH:
                at, code, begin, last = runs(data)
                found.append((code, np.full(len(at), row), np.full(len(at), doc), at, last - begin + 32 * (at - begin)))
        if found:
            code, row, doc, at, b = (np.concatenate(x) for x in zip(*found))
            yield _frame(code, row, doc, at.astype(np.int32), b.astype(np.int32))


def _second_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes of the runs of shared picks, which `picked` lists as numbers: pick, then b."""
    for pdf in batches:
        found = []
        for row, doc, text, picked in zip(pdf["row"], pdf["doc_id"], pdf["text"], pdf["picked"]):
            picked = np.sort(np.asarray(picked))
            back, size = picked >> 5 & 31, picked & 31
            begin = (picked >> 10) - back
            full = ranks(_bytes(text), LENGTH, _A)
            # A run's code sums those of its strings: equal sums mean equal strings, in whatever order.
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(full, dtype=np.uint64)])
            code = _pair(sums[begin + size + 1] - sums[begin], size.astype(np.uint64), _A)
            found.append((code, np.full(len(begin), row), np.full(len(begin), doc), begin, size + 32 * back))
        if found:
            keys, row, doc, a, b = (np.concatenate(x) for x in zip(*found))
            yield _frame(keys, row, doc, a.astype(np.int32), b.astype(np.int32))


def _third_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes of the pieces that the strings of each part of a run have in common."""
    for pdf in batches:
        found = []
        for row, doc, text, left in zip(pdf["row"], pdf["doc_id"], pdf["text"], pdf["left"]):
            data = _bytes(text)
            left = np.sort(np.asarray(left))
            begin = left >> 10
            last, at = begin + (left & 31), begin + (left >> 5 & 31)
            full = ranks(data, LENGTH - STEP, _A)
            for part in range(PARTS):
                # The piece begins where the part's last string may begin; the part before ends one earlier.
                piece = at if part == PARTS - 1 else at - (LENGTH - SHORT) + STEP * (part + 1)
                a = np.maximum(begin, at - (LENGTH - SHORT) + STEP * part + (part > 0))
                b = np.minimum(last, piece)
                some = a <= b
                code = _mix(full[piece[some]] + np.uint64(part))
                found.append((code, np.full(len(code), row), np.full(len(code), doc), a[some], b[some]))
        if found:
            keys, row, doc, a, b = (np.concatenate(x) for x in zip(*found))
            yield _frame(keys, row, doc, a.astype(np.int32), b.astype(np.int32))


def _fourth_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes of the single strings of runs that no smaller document repeats as a whole.

    Strings that a smaller document of the batch holds are settled: neighbours among them
    travel as one row, from the first start to the last. Of the others, b is not used.
    """
    for pdf in batches:
        found = []
        for row, doc, text, left in zip(pdf["row"], pdf["doc_id"], pdf["text"], pdf["left"]):
            data = _bytes(text)
            left = np.sort(np.asarray(left))
            first, size = left >> 10, (left & 1023) + 1
            # Parts of runs do not overlap, so their starts are in order.
            starts = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            found.append((ranks(data, LENGTH, _A)[starts], np.full(len(starts), row), np.full(len(starts), doc), starts))
        if found:
            keys, row, doc, a = (np.concatenate(x) for x in zip(*found))
            low, shared = _once(keys, doc)
            r, d, at = row[~low], doc[~low], a[~low]
            first = np.ones(len(r), bool)
            first[1:] = (r[1:] != r[:-1]) | (at[1:] != at[:-1] + 1)
            last = np.append(first[1:], True)[:len(r)]
            own = _mix(r[first].astype(np.uint64) * _B + at[first].astype(np.uint64))
            yield pd.DataFrame({
                "code": np.concatenate([keys[low], own]).view(np.int64), "row": np.concatenate([row[low], r[first]]),
                "doc_id": np.concatenate([doc[low], d[first]]),
                "a": np.concatenate([a[low], at[first]]).astype(np.int32),
                "b": np.concatenate([np.full(int(low.sum()), -1), at[last]]).astype(np.int32),
                "low": np.repeat([True, False], [int(low.sum()), int(first.sum())]),
                "known": np.concatenate([shared[low], np.ones(int(first.sum()), bool)])})


def _ranked(rows: DataFrame) -> DataFrame:
    """The least and greatest document of every rank, beside each of its rows."""
    rank = Window.partitionBy("code")
    return rows.withColumns({"least": F.min("doc_id").over(rank), "most": F.max("doc_id").over(rank)})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, copy, gone in zip(pdf["doc_id"], pdf["text"], pdf["copy"], pdf["gone"]):
            data = _bytes(text)
            spans = [(0, len(data))] if copy and len(data) >= LENGTH else sorted(
                (int(x) >> 32, (int(x) & 0xFFFFFFFF) + LENGTH) for x in (gone if gone is not None else ()))
            merged: list[list[int]] = []
            for a, b in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            kept, end = [], 0
            for a, b in merged:
                kept.append(data[end:a].tobytes())
                end = b
            kept.append(data[end:].tobytes())
            left = b"".join(kept)
            out.append((doc, len(data), len(data) - len(left), len(merged),
                        hashlib.sha256(left).hexdigest(), merged))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def repeated_substrings(docs: DataFrame) -> DataFrame:
    """One row for each input row: its size, what repeats smaller documents, and what is left."""
    # A key made from the data: it holds in every job, however the scan is split. Rows that repeat
    # both doc_id and text have one key and the same spans.
    docs = small_batches(docs).select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    coded = docs.select("row", "doc_id", F.sha2("text", 256).alias("code"))
    copies = (coded.filter("doc_id IS NOT NULL").groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
              .filter("n > 1"))
    copies = durable(coded.join(copies, "code").filter("doc_id > first").select("row").distinct())
    wide = docs.filter("doc_id IS NOT NULL")
    rows = wide.mapInPandas(_first_round, _ROW)
    shared = _ranked(rows.select("code", "row", "doc_id", "a", "b", "known")) \
        .filter("known OR least < most").select("row", "a", "b")
    # Copies are settled, and whatever they hold is held by the document that they copy.
    picked = shared.join(copies, "row", "left_anti").groupBy("row").agg(F.expr("collect_set(a * 1024L + b)").alias("picked"))
    picked = durable(picked)
    rows = wide.join(picked, "row").mapInPandas(_second_round, _ROW)
    second = durable(_ranked(rows).select(
        "row", "a", "b", (~F.col("low") | (F.col("least") < F.col("doc_id"))).alias("gone")))
    # A run, and later a part of one, as one number: its first start, then what b holds.
    left = second.filter("NOT gone").groupBy("row").agg(F.expr("collect_set(a * 1024L + b)").alias("left"))
    rows = wide.join(left, "row").mapInPandas(_third_round, _ROW)
    third = durable(_ranked(rows).filter("known OR least < most").select("row", "a", "b"))
    left = third.groupBy("row").agg(F.expr("collect_set(a * 1024L + b - a)").alias("left"))
    rows = wide.join(left, "row").mapInPandas(_fourth_round, _ROW)
    fourth = _ranked(rows.drop("known")).filter("NOT low OR least < doc_id").selectExpr("row", "a", "IF(low, a, b) AS b")
    gone = (second.filter("gone").selectExpr("row", "a", "a + b % 32 AS b").unionByName(fourth)
            .groupBy("row").agg(F.expr("collect_set(shiftleft(CAST(a AS BIGINT), 32) + b)").alias("gone")))
    gone = durable(gone.join(copies.withColumn("copy", F.lit(True)), "row", "full")
                    .select("row", "gone", F.coalesce("copy", F.lit(False)).alias("copy")))
    return (docs.join(gone, "row", "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "gone")
            .mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
                               " spans array<array<int>>"))


@query("op10_suffix")
def op10_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_substrings(table(spark, folder, "documents")).drop("spans")
