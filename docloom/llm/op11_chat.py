"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: an assistant turn as `<s>text</s>`, any other as
`[INST]role`, a line end, `text[/INST]`. Control strings (the four marks and the special
tokens of the tokenizer) inside roles and texts get a backslash behind their first
character, backslashes are doubled, and so is undone what was written: `Chat.read` gives
roles and texts back. The rendered text is encoded once, with the marks as added tokens and
with the offsets of every token; the turns' spans are sorted, and a binary search among them
tells each token's span: tokens of assistant texts carry loss.

Rows are dealt out by ranges of (conv_id, turn) and sorted, so a conversation of any length
lies over many tasks in order. A task renders what it holds of a conversation in sections of
at most `section` characters (a longer turn is a section by itself); as a mark always stands
between turns and is a token of its own, sections encode to the same tokens as the whole.
Nearly all conversations are one section. `part` orders the sections of one, and `alone`
says that there is certainly no other. Memory is bounded by a section; nothing is collected.

Null roles and texts are empty, and an empty assistant text has no loss. Rows of one turn
number are ordered by role and text; repeated rows are turns of their own. Rows without
conv_id are one conversation. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import query, small_batches, table
from docloom.llm.op7_bpe import default_path

ASSISTANT = "assistant"
MARKS = ("<s>", "</s>", "[INST]", "[/INST]")
SECTION = 1 << 20
# Characters of finished sections that a task holds back for one Arrow batch.
FLUSH = 1 << 22

_TURN = re.compile(r"<s>(.*?)</s>|\[INST\]((?:[^\\\n]|\\.)*)\n(.*?)\[/INST\]", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Chat:
    """Template and tokenizer of one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.controls = [*MARKS, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls:
            if c in text:
                text = text.replace(c, f"{c[0]}\\{c[1:]}")
        return text

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
        """The text of all turns, and (role, start, end) of what each says in it."""
        out, spans, at = [], [], 0
        for role, text in turns:
            said = self.escape(text)
            if role == ASSISTANT:
                head, tail = "<s>", "</s>"
            else:
                name = self.escape(role).replace("\n", "\\\n")
                head, tail = f"[INST]{name}\n", "[/INST]"
            spans.append((role, at + len(head), at + len(head) + len(said)))
            out += (head, said, tail)
            at = spans[-1][2] + len(tail)
        return "".join(out), spans

    @staticmethod
    def read(formatted: str) -> list[tuple[str, str]]:
        """The turns that were rendered."""
        turns, at = [], 0
        while at < len(formatted):
            found = _TURN.match(formatted, at)
            if found is None:
                raise ValueError(f"no turn at {at}")
            own, role, said = found.groups()
            turns.append((ASSISTANT, unescape(own)) if own is not None else (unescape(role), unescape(said)))
            at = found.end()
        return turns

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets in code points) of each text."""
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            n = len(e.ids)
            flat = (x for pair in e.offsets for x in pair)
            yield np.fromiter(e.ids, np.int32, n), np.fromiter(flat, np.int32, 2 * n).reshape(n, 2)


_LOADED: dict[str, Chat] = {}


def load(path: str) -> Chat:
    """Once for each Python process."""
    if path not in _LOADED:
        _LOADED[path] = Chat(path)
    return _LOADED[path]


def loss_mask(offsets: np.ndarray, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Whether each token overlaps a span of the assistant; spans are in order and do not overlap."""
    own = np.array([(a, b) for role, a, b in spans if role == ASSISTANT and a < b], np.int32).reshape(-1, 2)
    if not len(own):
        return np.zeros(len(offsets), bool)
    # The last span that begins before the token ends.
    at = np.searchsorted(own[:, 0], offsets[:, 1], "left") - 1
    return (at >= 0) & (own[np.maximum(at, 0), 1] > offsets[:, 0])


def masked(formatted: str, offsets: np.ndarray, loss: np.ndarray) -> str:
    """All text under the mask, unescaped. Tokens of one character's bytes share its place."""
    starts, ends = offsets[loss, 0], offsets[loss, 1]
    if not len(starts):
        return ""
    # Runs of tokens that touch.
    cut = np.flatnonzero(starts[1:] > np.maximum.accumulate(ends)[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(starts)) - 1
    high = np.maximum.accumulate(ends)
    return "".join([unescape(formatted[a:b]) for a, b in zip(starts[first].tolist(), high[last].tolist())])


def sections(rows: Iterator[tuple], limit: int) -> Iterator[tuple]:
    """(conv_id, alone, turns) of consecutive (conv_id, role, text) rows."""
    turns, size, conv, first, cut = [], 0, None, True, False
    for key, role, text in rows:
        role, text = role or "", text or ""
        if turns and (key != conv or size + len(text) > limit):
            # A task's first conversation may have begun in the task before.
            yield conv, key != conv and not first and not cut, turns
            first, cut = first and key == conv, key == conv
            turns, size = [], 0
        conv = key
        turns.append((role, text))
        size += len(text)
    if turns:
        yield conv, False, turns


_SPAN = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_OFFSET = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _lists(arrays: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays), kind))


def format_chats(conversations: DataFrame, path: str | None = None, section: int = SECTION) -> DataFrame:
    """One row for each section: conv_id, part, alone, formatted, turns (role, start, end), token ids, their
    offsets (start, end), and loss, one flag a token. `path` is read by every worker."""
    where = path or default_path()
    kind = dict(conversations.dtypes)["conv_id"]

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, part, held, size = load(where), TaskContext.get().partitionId() << 32, [], 0
        types: list[pa.DataType] = []

        def rows():
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def flush() -> pa.RecordBatch:
            texts = [t for *_, t, _ in held]
            ids, offsets = zip(*chat.encode(texts))
            loss = [loss_mask(o, spans) for o, (*_, spans) in zip(offsets, held)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            both = np.concatenate(offsets)
            places = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], fields=list(_OFFSET))
            turns = [[{"role": r, "start": a, "end": b} for r, a, b in spans] for *_, spans in held]
            return pa.RecordBatch.from_arrays([
                pa.array([c for c, *_ in held], types[0]), pa.array([p for _, p, *_ in held], pa.int64()),
                pa.array([a for _, _, a, *_ in held], pa.bool_()), pa.array(texts, pa.string()),
                pa.array(turns, pa.list_(_SPAN)), _lists(ids, pa.int32()), pa.ListArray.from_arrays(ends, places),
                _lists(loss, pa.bool_()),
            ], names=["conv_id", "part", "alone", "formatted", "turns", "ids", "offsets", "loss"])

        for conv, alone, turns in sections(rows(), section):
            text, spans = chat.render(turns)
            held.append((conv, part, alone, text, spans))
            part, size = part + 1, size + len(text)
            if size >= FLUSH or len(held) >= 500:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    keys = ["conv_id", "turn"]
    return (small_batches(conversations).select("conv_id", "turn", "role", "text")
            .repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "text")
            .select("conv_id", "role", "text")
            .mapInArrow(formatted, f"conv_id {kind}, part long, alone boolean, formatted string,"
                                   " turns array<struct<role: string, start: int, end: int>>, ids array<int>,"
                                   " offsets array<struct<start: int, end: int>>, loss array<boolean>"))


_READ = ("part long, alone boolean, n_turns long, turns binary, loss_chars long, loss binary, formatted_chars long")
_DIGEST = ("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a section says: all turns as bytes, and the text under its mask. Of a whole conversation
    only the digests go on."""
    for batch in batches:
        conv, part, alone, formatted, offsets, loss = batch.columns
        out = []
        for i, text in enumerate(formatted.to_pylist()):
            turns = Chat.read(text)
            said = "".join([f"{role}\n{t}\n" for role, t in turns]).encode()
            places = offsets[i].values
            both = np.stack([places.field(k).to_numpy() for k in (0, 1)], axis=1)
            own = masked(text, both, loss[i].values.to_numpy(zero_copy_only=False))
            pieces = said, own.encode()
            if alone[i].as_py():
                pieces = [hashlib.sha256(p).digest() for p in pieces]
            out.append((len(turns), pieces[0], len(own), pieces[1], len(text)))
        n, turns, chars, own, size = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [conv, part, alone, pa.array(n, pa.int64()), pa.array(turns, pa.binary()), pa.array(chars, pa.int64()),
             pa.array(own, pa.binary()), pa.array(size, pa.int64())],
            names=["conv_id", "part", "alone", "n_turns", "turns", "loss_chars", "loss", "formatted_chars"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its sections in order; only running digests are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    open_, types = None, []

    def done(rows: list) -> pa.RecordBatch:
        kinds = [types[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def closed(x: list) -> list:
        return [v.hexdigest() if hasattr(v, "hexdigest") else v for v in x]

    for batch in batches:
        types[:] = [batch.schema.field(0).type]
        out = []
        for conv, _, alone, n, turns, chars, own, size in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ is not None and (alone or open_[0] != conv):
                out.append(closed(open_))
                open_ = None
            if alone:
                out.append([conv, n, turns.hex(), chars, own.hex(), size])
                continue
            if open_ is None:
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            open_[2].update(turns)
            open_[4].update(own)
            for k, v in ((1, n), (3, chars), (5, size)):
                open_[k] += v
        if out:
            yield done(out)
    if open_ is not None:
        yield done([closed(open_)])


def digests(chats: DataFrame) -> DataFrame:
    """One row a conversation, read back from the formatted texts and their masks."""
    kind = dict(chats.dtypes)["conv_id"]
    read = chats.select("conv_id", "part", "alone", "formatted", "offsets", "loss").mapInArrow(
        _read_back, f"conv_id {kind}, {_READ}")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        _joined, f"conv_id {kind}, {_DIGEST}")


@query("op11_chat")
def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    chats = table(spark, folder, "conversations").select(*probe.columns).unionByName(probe)
    return digests(format_chats(chats))
