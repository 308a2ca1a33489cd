"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document).  A visitor
flattens them into one string with ordered placeholders and records, for each
attachment, its reference and how many tokens its placeholder expands to.  The
template marks turns as::

    ### role:
    content</turn>

Control strings inside roles, texts and references are escaped with a backslash,
reversibly.  The loss mask covers the content of assistant turns.

Conversations are rendered turn by turn in sorted partitions, so a conversation of
any length needs the memory of one turn.  Turns are ordered by turn, then role,
then text; rows that repeat are turns each.  Null text is empty, a null role is the
empty role, null ids form one conversation.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
CONTROL = re.compile(r"\\|###|</turn>|<\|")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
HOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")

PATCH, TILE_TOKENS = 28, 1
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 576


def escape(text: str) -> str:
    """Puts a backslash before every control string (and backslash)."""
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


class Flattener:
    """Visits the parts of a turn; one method a type."""

    def __init__(self, first: int):
        self.number, self.pieces, self.attachments = first, [], []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"<|{kind}:{self.number}|>")
        self.attachments.append({"number": self.number, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.number += 1

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width") or 0, part.get("height") or 0
        self.attach("image", part, max(1, math.ceil(w / PATCH) * math.ceil(h / PATCH) * TILE_TOKENS))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, (part.get("pages") or 0) * DOCUMENT_TOKENS_A_PAGE))
        if part.get("text"):
            self.visit_text(part)


def render(role: str, content: str) -> tuple[str, int, int]:
    """The turn, and where its content starts and ends in it."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}:\n"
    return f"{head}{content}</turn>\n", len(head), len(head) + len(content)


SEGMENT = (
    "conv_id bigint, number bigint, segment string, start bigint, loss_start bigint, loss_end bigint, "
    "attachments array<struct<number: bigint, type: string, ref: string, tokens: bigint>>"
)
ATTACHMENT = pa.list_(pa.struct([("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def text_part(text: Column) -> Column:
    """A lone text part."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()]))


def render_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, partitions: int | None = None) -> DataFrame:
    """A row a turn: its segment, where it starts in the conversation's string, the masked span in that string, its attachments.

    The rows of a conversation stand together and in order; the string of a
    conversation is its segments joined.
    """
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content = F.col(parts).cast(PART) if parts else text_part(F.col(text))
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("parts"),
    )
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))

    def run(batches):
        last, number, at, attached = object(), 0, 0, 0
        for batch in batches:
            out = []
            for conv_id, _, who, held in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != last:
                    last, number, at, attached = conv_id, 0, 0, 0
                visitor = Flattener(attached)
                for part in held or []:
                    visitor.visit(part)
                segment, a, b = render(who, "".join(visitor.pieces))
                loss = who == "assistant"
                out.append((conv_id, number, segment, at, at + a if loss else None, at + b if loss else None, visitor.attachments))
                number, at, attached = number + 1, at + len(segment), visitor.number
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), ATTACHMENT)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=["conv_id", "number", "segment", "start", "loss_start", "loss_end", "attachments"])

    return rows.mapInArrow(run, SEGMENT)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(segments: DataFrame, ordered: bool = True, partitions: int | None = None) -> DataFrame:
    """Parses rendered conversations: turns, their digest, the text under the loss mask and its digest, the length.

    ordered: the rows still stand as ``render_conversations`` left them; else they are dealt and sorted anew.
    """
    rows = segments.select("conv_id", "number", "segment", "start", "loss_start", "loss_end")
    if not ordered:
        n = partitions or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "number")

    def run(batches):
        last, state = object(), None
        names = [f.split()[0] for f in DIGEST.split(", ")]

        def table(done):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [()] * 6, kinds)], names=names)

        def close(conv_id, s):
            return conv_id, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

        for batch in batches:
            done = []
            for conv_id, _, segment, start, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != last or state is None:
                    if state is not None:
                        done.append(close(last, state))
                    last, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = TURN.fullmatch(segment)
                if not m or start != state[4]:
                    raise ValueError(f"conversation {conv_id} can't be read back at {start}")
                content = unescape(m[2])
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{content}\n".encode())
                if a is not None:
                    under = unescape(segment[a - start : b - start])
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(segment)
            if done:
                yield table(done)
        if state is not None:
            yield table([close(last, state)])

    return rows.mapInArrow(run, DIGEST)
