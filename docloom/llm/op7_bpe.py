"""Byte-level BPE encoding by forced-boundary splitting, and decoding.

A pair of adjacent bytes that occurs inside no vocabulary entry can never end up in one
token, whatever the order of merges. Such a pair is therefore a certain cut: what stands
before and after it is encoded on its own and the ids are concatenated. The merges within
a fragment are left to a library; ids of common words are kept.

Null texts are empty; an empty text has no ids. Lone added tokens (`<|endoftext|>`) written
out in a text become their own id, as in the tokenizers library. Every row is encoded by
itself: repeated rows give repeated results, other columns are kept as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from docloom.llm.common import query, small_batches, table

# Words whose ids a Python worker keeps: the first ones it meets, which are the commonest.
CACHE = 100_000

_WIDE_SPACE = r"\t-\r \x85\xa0  -     　"
_WIDE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WIDE_SPACE + r"\p{L}\p{N}]+"
    r"|[" + _WIDE_SPACE + r"]+(?![^" + _WIDE_SPACE + r"])|[" + _WIDE_SPACE + r"]+")
# The same rule for texts of code points below 256, for which it is spelt out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_NARROW = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def pre_tokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
        return _NARROW.findall(text)
    except UnicodeEncodeError:
        return _WIDE.findall(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary and certain cuts of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = _alphabet()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items()
                    if k not in self.added}
        self.entry = {v: k for k, v in self.ids.items()}
        self.entry |= {v: k.encode() for k, v in self.added.items()}
        joined = {entry[i:i + 2] for entry in self.ids for i in range(len(entry) - 1)}
        self.cut = {bytes((a, b)) for a in range(256) for b in range(256)} - joined
        # Ids follow the order of merges, so they are the ranks by which a fragment is merged.
        self.piece = tiktoken.Encoding(
            "fragments", pat_str=r"[\s\S]", mergeable_ranks=self.ids, special_tokens={})._encode_single_piece
        self.words: dict[str, tuple] = {}
        self.split_added = (
            re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None)

    def fragments_of(self, word: bytes) -> list[bytes]:
        cut, out, start = self.cut, [], 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] in cut:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def word(self, word: str) -> tuple:
        """Ids of a pre-token: those of its fragments, one after the other."""
        out: list[int] = []
        for fragment in self.fragments_of(word.encode()):
            out += self.piece(fragment)
        ids = tuple(out)
        if len(self.words) < CACHE and len(word) < 100:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, put = self.words, ids.extend
        parts = [text]
        if self.split_added and any(a in text for a in self.added):
            parts = self.split_added.split(text)
        for part in parts:
            if part in self.added:
                ids.append(self.added[part])
                continue
            for w in pre_tokens(part):
                got = known.get(w)
                put(self.word(w) if got is None else got)
        return ids

    def decode(self, ids) -> str:
        entry = self.entry
        return b"".join([entry[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """Once for each Python process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(df: DataFrame, text: str = "text", out: str = "token_ids",
           path: str | None = None) -> DataFrame:
    """Add `out`: the ids as packed little-endian 32-bit integers. `path` is read by every worker."""
    where = path or default_path()

    @F.pandas_udf(BinaryType())
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(where)
        for texts in batches:
            yield pd.Series([np.array(bpe.encode(t or ""), "<u4").tobytes() for t in texts],
                            dtype=object)

    return small_batches(df).withColumn(out, packed(F.col(text)))


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded",
           path: str | None = None) -> DataFrame:
    """Add `out`: the text of packed ids."""
    where = path or default_path()

    @F.pandas_udf(StringType())
    def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(where)
        for packs in batches:
            yield pd.Series([bpe.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in packs],
                            dtype=object)

    return small_batches(df).withColumn(out, unpacked(F.col(ids)))


def round_trip(df: DataFrame, text: str = "text", out: str = "coded",
               path: str | None = None) -> DataFrame:
    """Add `out`: struct of packed `ids` and the text `decoded` from them, in one worker."""
    where = path or default_path()

    @F.pandas_udf("ids binary, decoded string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(where)
        for texts in batches:
            ids = [np.array(bpe.encode(t or ""), "<u4") for t in texts]
            yield pd.DataFrame({"ids": [x.tobytes() for x in ids],
                                "decoded": [bpe.decode(x.tolist()) for x in ids]}, dtype=object)

    return small_batches(df).withColumn(out, coded(F.col(text)))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each document: counts and digests of its ids and of the decoded text."""
    return round_trip(docs.select("doc_id", "text"), path=path).select(
        "doc_id",
        F.floor(F.octet_length("coded.ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("coded.decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op7_bpe")
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
