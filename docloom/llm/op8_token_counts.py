"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a block of texts are put in a trie. The unigram forward score of
a prefix (best sum of token scores, then fewest tokens) is computed once at its trie node,
for all pre-tokens that begin with it; a pre-token's count is stored at its terminal node.
In sorted order the nodes shared with the pre-token before are the common prefix, so the
trie is walked as one path of scores and never holds more than the longest pre-token.

Token scores are log-probabilities of Zipf's law over the ids of the vocabulary file (ids
follow the merge order, the commonest first): score = -log(id + 1). Nothing is trained.
Every byte is a token, so each text has a segmentation. Counts are per row, with memory
bounded by a block of texts, and no shuffle. Null and empty texts have 0 tokens; repeated
rows are counted each; other columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import query, small_batches, table
from docloom.llm.op7_bpe import default_path, load, pre_tokens

KNOWN = 150_000


class Counter:
    """Best segmentations under unigram scores, one trie path at a time."""

    def __init__(self, ids: dict[bytes, int]):
        self.score = {k: -math.log(v + 1) for k, v in ids.items()}
        # By last byte, the lengths that entries ending in it have, shortest first.
        ends: list[set[int]] = [set() for _ in range(256)]
        for k in ids:
            ends[k[-1]].add(len(k))
        self.lengths = [sorted(x) for x in ends]
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> None:
        """Store the counts of new distinct words."""
        path: list[tuple[float, int]] = [(0.0, 0)]
        before, score, lengths = b"", self.score, self.lengths
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(raw), len(before))
            while shared < most and raw[shared] == before[shared]:
                shared += 1
            del path[shared + 1:]
            for end in range(shared + 1, len(raw) + 1):
                best = None
                for n in lengths[raw[end - 1]]:
                    if n > end:
                        break
                    s = score.get(raw[end - n:end])
                    if s is not None:
                        p = path[end - n]
                        new = (p[0] + s, p[1] - 1)
                        if best is None or new > best:
                            best = new
                path.append(best)
            self.known[word] = -path[-1][1]
            before = raw

    def texts(self, texts: list[str]) -> list[int]:
        split = [pre_tokens(t) for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.counts(list({w for words in split for w in words} - self.known.keys()))
        known = self.known
        return [sum([known[w] for w in words]) for words in split]


def token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens",
                 path: str | None = None) -> DataFrame:
    """Add the number of unigram tokens of each text."""
    where = path or default_path()

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(load(where).ids)
        for texts in batches:
            yield pd.Series(counter.texts([t or "" for t in texts]))

    return small_batches(docs).withColumn(out, counted(F.col(text)))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
