"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole: each turn is ``<|role|>`` role ``<|text|>`` text
``<|end|>``. Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so
control strings occur only where the template puts them and texts can be read back. The
rendered string is encoded once, with offsets; control strings are single tokens. Spans of
assistant texts and token spans are both sorted, so binary search gives the tokens that
meet a span, and these are the loss mask.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), then
role, then text; rows of a null conv_id are a conversation of their own; repeated rows are
repeated turns, and turns that are equal in number are ordered by role and text; a very long
conversation is one string and one encoding, which is what the mask needs, and so one task's memory bounds
its length; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Characters encoded in one call at most, besides a single longer conversation.
BATCH_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out += [text[at:i], text[i + 1 : i + 2]]
        at = i + 2
    return "".join([*out, text[at:]])


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(spans: list[tuple[int, int]], offsets: np.ndarray) -> np.ndarray:
    """Which tokens meet a span; spans and token offsets are sorted."""
    out = np.zeros(len(offsets) + 1, dtype=np.int32)
    if len(offsets) and spans:
        begin, stop = np.array(spans).T
        first = np.searchsorted(offsets[:, 1], begin, side="right")
        last = np.searchsorted(offsets[:, 0], stop, side="left")
        some = (stop > begin) & (last > first)
        np.add.at(out, first[some], 1)
        np.add.at(out, last[some], -1)
    return np.cumsum(out[:-1]) > 0


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(ROLE).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def read_loss(formatted: str, masked, starts, stops) -> list[str]:
    """The texts under the mask: one for each run of masked tokens."""
    edges = np.diff(np.concatenate([[0], np.asarray(masked, dtype=np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    return [unescape(formatted[starts[i] : stops[j]]) for i, j in zip(first.tolist(), last.tolist())]


def _tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (ROLE, TEXT, END)])
    return t


OUTPUT = "conv_id long, formatted string, token_ids array<int>, starts array<int>, stops array<int>, loss array<boolean>"


def _turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _format(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = _tokenizer(tokenizer)

    def encode(held):
        encoded = t.encode_batch([h[1] for h in held], add_special_tokens=False)
        offsets = [np.array(e.offsets, dtype=np.int64).reshape(-1, 2) for e in encoded]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([h[0] for h in held], pa.int64()),
                pa.array([h[1] for h in held], pa.string()),
                pa.array([e.ids for e in encoded], pa.list_(pa.int32())),
                pa.array([o[:, 0] for o in offsets], pa.list_(pa.int32())),
                pa.array([o[:, 1] for o in offsets], pa.list_(pa.int32())),
                pa.array([mask(h[2], o) for h, o in zip(held, offsets)], pa.list_(pa.bool_())),
            ],
            names=["conv_id", "formatted", "token_ids", "starts", "stops", "loss"],
        )

    for batch in batches:
        held, chars = [], 0
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.append((conv, *render([(x["role"], x["text"]) for x in turns.as_py()])))
            chars += len(held[-1][1])
            if chars >= BATCH_CHARS:
                yield encode(held)
                held, chars = [], 0
        if held:
            yield encode(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what can be read back from the formatted string, its offsets and its mask."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        out = []
        for conv, text, starts, stops, loss in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "formatted", "starts", "stops", "loss"))):
            text = text.as_py()
            turns = read_turns(text)
            under = "".join(read_loss(text, loss.values.to_numpy(zero_copy_only=False), starts.values.to_numpy(), stops.values.to_numpy()))
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((conv.as_py(), len(turns), sha(whole), len(under), sha(under), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in DIGESTS.split(", ")])


OUTPUT = "conv_id long, formatted string, token_ids array<int>, starts array<int>, stops array<int>, loss array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(rows: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation: the formatted string, its tokens with offsets, and the loss mask."""
    return _turns(rows).mapInArrow(lambda batches: _format(batches, tokenizer), OUTPUT)


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, as they are read back."""
    return formatted.select("conv_id", "formatted", "starts", "stops", "loss").mapInArrow(_digests, DIGESTS)


def format_digests(rows: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """The digests of ``format_conversations``, read back where the conversation is formatted: tokens do not leave the task."""
    return _turns(rows).mapInArrow(lambda batches: _digests(_format(batches, tokenizer)), DIGESTS)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings, read back from their formatted form."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    says = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return format_digests(rows.unionAll(more))
