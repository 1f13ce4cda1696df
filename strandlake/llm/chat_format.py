"""Operator 5, chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted
spans of its turns are met with the sorted token spans by binary search. The
control strings are special tokens, so no token crosses a turn's border.

A turn is ``<s>`` role ``[INST]`` text ``[/INST]</s>``. Inside roles and texts a
control string's first character is written as a backslash and a letter, and a
backslash as two, so rendered text is read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_arrow

# The template's control strings.
OPEN, TEXT, SHUT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, TEXT, SHUT, END)

_ESCAPE = re.compile(r"\\|\[(?=/?INST\])|<(?=/?s>)")
_OUT = {"\\": "\\\\", "[": "\\b", "<": "\\a"}
_BACK = {"\\": "\\", "b": "[", "a": "<"}
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)

#: A role whose text counts for the loss, and conversations that are Python objects at once.
LEARNED = "assistant"
SLICE = 64


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The rendered conversation and the (start, end, role) of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{OPEN}{escape(role)}{TEXT}", escape(text), f"{SHUT}{END}"
        parts += [head, body, tail]
        spans.append((at + len(head), at + len(head) + len(body), role))
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def load_tokenizer(path: str):
    """The byte-level tokenizer with the control strings as special tokens after its own ids."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(list(CONTROLS))
    return tokenizer


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int, str]], learned: str = LEARNED) -> list[int]:
    """Per token 1 if its span lies in the text of a learned turn, found by binary search in the sorted token spans."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask = [0] * len(offsets)
    for a, b, role in spans:
        if role == learned and a < b:
            first, last = bisect_right(ends, a), bisect_left(starts, b)
            if first < last and (starts[first] < a or ends[last - 1] > b):
                raise ValueError("a token crosses a turn's border")
            mask[first:last] = [1] * (last - first)
    return mask


def masked_spans(offsets: list[tuple[int, int]], mask: list[int]) -> list[tuple[int, int]]:
    """Maximal character spans under the mask; tokens of one character's bytes share its span."""
    out: list[tuple[int, int]] = []
    open_run = False
    for (a, b), m in zip(offsets, mask):
        if not m:
            open_run = False
        elif open_run:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
            open_run = True
    return out


def format_rows(conversations: DataFrame, tokenizer_path: str, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Rows (conv_id, formatted, ids array<int>, mask array<byte>, offsets) per conversation.

    Turns go by number (nulls first), ties by role and then text, repeated rows
    repeat; null texts and roles are empty; a null conv_id is a conversation of
    its own; no rows give none. One conversation is one rendered text, so its
    turns are gathered; conversations are spread by a hash of their id.
    """

    def run(batches):
        tokenizer = load_tokenizer(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                out, part = [], b.slice(at, SLICE)
                for conv, turns in zip(part.column(0), part.column(1)):
                    formatted, spans = render([(t["role"], t["text"]) for t in turns.as_py()])
                    e = tokenizer.encode(formatted, add_special_tokens=False)
                    out.append(dict(conv_id=conv.as_py(), formatted=formatted, ids=e.ids, mask=loss_mask(e.offsets, spans), starts=[x for x, _ in e.offsets], ends=[y for _, y in e.offsets]))
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return map_arrow(whole, run, "conv_id long, formatted string, ids array<int>, mask array<tinyint>, starts array<int>, ends array<int>")


def digest_rows(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say, read back from them: turns, and the text under the loss mask."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                out = []
                for r in b.slice(at, SLICE).to_pylist():
                    turns = read_back(r["formatted"])
                    spans = masked_spans(list(zip(r["starts"], r["ends"])), r["mask"])
                    loss = "".join(unescape(r["formatted"][a:z]) for a, z in spans)
                    told = "".join(f"{role}\n{text}\n" for role, text in turns)
                    out.append(
                        dict(conv_id=r["conv_id"], n_turns=len(turns), turns_sha256=hashlib.sha256(told.encode()).hexdigest(), loss_chars=len(loss),
                             loss_sha256=hashlib.sha256(loss.encode()).hexdigest(), formatted_chars=len(r["formatted"]))
                    )
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return map_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
