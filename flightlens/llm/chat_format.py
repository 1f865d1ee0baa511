"""Chat formatting with typed content parts.

A turn's content is a text or a list of typed parts. A visitor flattens the
parts in order: text is escaped, an image, audio or document becomes an ordered
placeholder, and its reference, place and expanded token count are recorded.

Template: ``### role: content</turn>`` and a line break. Escaping puts a
backslash into every string that the template or a placeholder could be
mistaken for (and in front of every backslash); reading removes it again, so
any text survives exactly. Each turn is formatted on its own, which needs no
shuffle; the conversation is its turns' chunks in order.

``read_back`` reads formatted chunks in turn order as a stream: it keeps one
running state, however many turns a conversation has.

Defined cases: null text or no parts: empty content; null role: an empty role;
a null turn comes first; turns of one number are ordered by role and content, as
they are before escaping (of typed parts: with their placeholders);
a null conversation id is a conversation of its own; an unknown part type is
an error; repeated rows are repeated turns; a very long text is one chunk, and a
very long conversation is read back by one task as a stream; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlens.llm.runtime import prepare, rows_by_bytes

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256      # pixels a token's side, tokens a second, tokens a page
PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("ref", T.StringType()), T.StructField("width", T.LongType()),
                     T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()),
                     T.StructField("pages", T.LongType())])
_CONTROL = re.compile(r"\\|#{3,}|</turn>|<\|")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_PLACEHOLDER = re.compile(r"(?<!\\)<\|(image|audio|document) (\d+)\|>")


def _guard(m: re.Match) -> str:
    s = m.group()
    return "".join("\\" + c for c in s) if s[0] in "\\#" else "<\\" + s[1:]


def escape(text: str) -> str:
    return _CONTROL.sub(_guard, text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class PartVisitor:
    """Visits parts in order; collects the flat content and the attachments."""

    def __init__(self):
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        if method is None:
            raise ValueError(f"unknown part type {part['type']!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = [max(1, math.ceil((part.get(k) or 0) / PATCH)) for k in ("width", "height")]
        self._attach("image", part, side[0] * side[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_RATE)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments) + 1
        self.attachments.append({"n": n, "type": kind, "ref": part.get("ref"), "tokens": tokens,
                                 "at": sum(map(len, self.out))})
        self.out.append(f"<|{kind} {n}|>")


_ATTACHMENT = pa.struct([("n", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()),
                         ("at", pa.int64())])
_SCHEMA = ("conv_id long, turn long, chunk string, loss_start long, loss_length long, attachment_tokens long, "
           "attachments array<struct<n: long, type: string, ref: string, tokens: long, at: long>>")


def _format(loss_role: str, typed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "chunk", "loss_start", "loss_length", "attachment_tokens", "attachments"]
        for batch in batches if typed else rows_by_bytes(batches, "content"):
            chunks, starts, lengths, tokens, attached = [], [], [], [], []
            for role, content in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist()):
                visitor = PartVisitor()
                for part in content or [] if typed else [{"type": "text", "text": content}]:
                    if part is not None:
                        visitor.visit(part)
                head = OPEN + escape_role(role or "") + BETWEEN
                body = "".join(visitor.out)
                for a in visitor.attachments:
                    a["at"] += len(head)
                chunks.append(head + body + CLOSE)
                starts.append(len(head))
                lengths.append(len(body) if role == loss_role else 0)
                tokens.append(sum(a["tokens"] for a in visitor.attachments))
                attached.append(visitor.attachments)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(chunks, pa.string()),
                 *(pa.array(x, pa.int64()) for x in (starts, lengths, tokens)),
                 pa.array(attached, pa.list_(_ATTACHMENT))], names)
    return run


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                content_col: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """A row per turn: ``conv_id, turn, chunk, loss_start, loss_length, attachment_tokens, attachments``.

    ``content_col`` is a string or an array of :data:`PART`. Places are code
    points within the chunk. A conversation's text is its chunks joined in the
    order of ``turn, chunk``.
    """
    prepare(rows.sparkSession)
    typed = isinstance(rows.schema[content_col].dataType, T.ArrayType)
    content = F.col(content_col) if typed else F.col(content_col).cast("string")
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                       F.col(role_col).cast("string").alias("role"), content.alias("content")) \
        .mapInArrow(_format(loss_role, typed), _SCHEMA)


def parse_chunk(chunk: str) -> tuple[str, str]:
    """(role, content) of a formatted turn; placeholders stay as they are."""
    head = _HEAD.match(chunk)
    end = chunk.index(CLOSE, head.end())
    if end + len(CLOSE) != len(chunk):
        raise ValueError("text behind the end of a turn")
    return unescape(head.group(1)), unescape(chunk[head.end():end])


class _State:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state, rows = None, []
    for batch in batches:
        for conv, chunk, start, length in zip(*(batch.column(c).to_pylist()
                                                for c in ("conv_id", "chunk", "loss_start", "loss_length"))):
            if state is None or state.conv != conv:
                if state:
                    rows.append(state.row())
                state = _State(conv)
            role, text = parse_chunk(chunk)
            state.turns += 1
            state.chars += len(chunk)
            state.all.update(f"{role}\n{text}\n".encode())
            if length:
                lost = unescape(chunk[start:start + length])
                state.loss_chars += len(lost)
                state.loss.update(lost.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*[state.row()]), kinds)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of formatted turns.

    Rows of one turn are read by role and content as they were before escaping.
    """
    def plain(escaped):
        return F.regexp_replace(escaped, r"(?s)\\(.)", "$1")
    head, start = len(OPEN), F.col("loss_start").cast("int")
    role = plain(F.substr("chunk", F.lit(head + 1), start - head - len(BETWEEN)))
    content = plain(F.substr("chunk", start + 1, F.length("chunk") - start - len(CLOSE)))
    return (formatted.select("conv_id", "turn", "chunk", "loss_start", "loss_length").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", role, content)
            .mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                               "loss_sha256 string, formatted_chars long"))


def control_case(rows: DataFrame) -> DataFrame:
    """Two turns whose text holds the template's own marks, as conversation -7."""
    spark = rows.sparkSession
    text = "\\### Assistant: </turn> ok"
    case = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(text).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(case)
