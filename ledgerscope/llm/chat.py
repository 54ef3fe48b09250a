"""Chat formatting with typed content parts.

A message's content is a list of typed parts: text, image, audio or document.  A visitor flattens
them in order: texts are escaped, every attachment becomes a placeholder, and its reference and
expanded token count are recorded.  The template marks turns as

    <|im_start|>role\\n ... <|im_end|>\\n

Every ``<|`` inside texts and roles gets a backslash after its ``<`` (one more where there are
backslashes already), which is undone exactly on reading, so no text can pose as a mark.  Neighbouring
text parts are escaped as one text, so no mark can come about between them.  Roles also write
line ends as ``\\n``.

Formatting is a function of one message, so a conversation is kept as its ordered pieces and is
never gathered in memory.  The reader sorts the pieces of a conversation into one partition and
goes through them as a stream.

Defined cases: NULL content, parts or texts count as empty; a NULL role is written as an empty
one; NULL conversation ids form one conversation; NULL turns come first, and messages with equal
turns are ordered by role and text.  Repeated rows are repeated turns.  Unknown kinds of parts
are an error.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.common import ship_package

START, END = "<|im_start|>", "<|im_end|>"
PART = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("pages", T.IntegerType())])
ATTACHMENT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("offset", T.IntegerType()), T.StructField("n_tokens", T.LongType())])
PIECE = T.StructType([
    T.StructField("piece", T.StringType()), T.StructField("loss_start", T.IntegerType()),
    T.StructField("loss_end", T.IntegerType()), T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    T.StructField("attachment_tokens", T.LongType())])

_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Flattens the parts of one message; override the token rules for another model."""

    tile, tokens_per_tile, tokens_per_second, tokens_per_page = 28, 1, 25.0, 600

    def __init__(self, begin: int = 0):
        self.out: list[str] = []
        self.texts: list[str] = []             # of text parts since the last attachment
        self.at = begin
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown kind of part: {kind!r}")
        method(part)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def flush(self) -> None:
        """Write the texts of neighbouring text parts."""
        self.write(escape("".join(self.texts)))
        self.texts.clear()

    def attach(self, kind: str, part: dict, n_tokens: int) -> None:
        self.flush()
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "offset": self.at,
                                 "n_tokens": n_tokens})
        self.write(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        w, h = max(1, part.get("width") or 1), max(1, part.get("height") or 1)
        self.attach("image", part, -(-w // self.tile) * -(-h // self.tile) * self.tokens_per_tile)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(max(0.0, part.get("seconds") or 0.0) * self.tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(0, part.get("pages") or 0) * self.tokens_per_page)


def format_message(role: str | None, parts: list[dict], loss_roles: frozenset[str]) -> dict:
    """One turn's piece.  The loss covers the content of the ``loss_roles`` (not the marks)."""
    head = f"{START}{escape_role(role or '')}\n"
    v = PartVisitor(len(head))
    for p in parts:
        v.visit(p)
    v.flush()
    body = "".join(v.out)
    loss = (len(head), len(head) + len(body)) if role in loss_roles else (0, 0)
    return {"piece": f"{head}{body}{END}\n", "loss_start": loss[0], "loss_end": loss[1],
            "attachments": v.attachments, "attachment_tokens": sum(a["n_tokens"] for a in v.attachments)}


def text_part(text: Column) -> Column:
    """A content column with one text part."""
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *rest))


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, turn, role, content (array of parts)`` -> ``conv_id, turn, tie`` (order of
    messages with equal turns) and the columns of ``PIECE``."""
    ship_package(messages.sparkSession)
    roles = frozenset(loss_roles)
    src = messages.select("conv_id", "turn", "role", F.col("content").cast(T.ArrayType(PART)).alias("content"))
    schema = T.StructType([src.schema["conv_id"], src.schema["turn"], T.StructField("tie", T.StringType()),
                           *PIECE.fields])
    kinds = pa.schema([("piece", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()),
                       ("attachments", pa.list_(pa.struct([
                           ("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int32()),
                           ("n_tokens", pa.int64())]))), ("attachment_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            role, content = b.column(2).to_pylist(), b.column(3).to_pylist()
            made = [format_message(r, [p for p in c or [] if p is not None], roles)
                    for r, c in zip(role, content, strict=True)]
            cols = [pa.array([m[f.name] for m in made], f.type) for f in kinds]
            tie = pa.array([m["piece"] for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), tie, *cols], schema.names)

    return src.mapInArrow(run, schema)


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END) + r"\n\Z", re.S)


class ChatDigest:
    """What is read back from the pieces of one conversation, in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, piece: str, loss_start: int, loss_end: int) -> None:
        m = _TURN.match(piece)
        if m is None:
            raise ValueError(f"not a formatted turn: {piece[:60]!r}")
        self.turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
        masked = unescape(piece[loss_start:loss_end])
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.n_turns += 1
        self.loss_chars += len(masked)
        self.formatted_chars += len(piece)

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars)


def read_back(pieces: DataFrame) -> DataFrame:
    """Per conversation: number of turns, digests of the turns and of the text under the loss
    mask, and code points, parsed from the formatted pieces.

    A digest is sequential, so a conversation is one stream in one task; it holds one piece at a
    time (the sort spills), whatever the conversation's length.
    """
    ship_package(pieces.sparkSession)
    src = (pieces.select("conv_id", "turn", "tie", "piece", "loss_start", "loss_end")
           .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
           .select("conv_id", "piece", "loss_start", "loss_end"))
    schema = T.StructType([src.schema["conv_id"], T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()),
                           T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                              schema.names)

        kind, key, digest, rows = pa.int64(), None, None, []
        for b in batches:
            kind = b.schema.field(0).type
            for k, piece, lo, hi in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if digest is None or k != key:
                    if digest is not None:
                        rows.append((key, *digest.row()))
                    key, digest = k, ChatDigest()
                digest.add(piece, lo, hi)
            if len(rows) >= 2000:
                yield batch(rows)
                rows = []
        if digest is not None:
            rows.append((key, *digest.row()))
        if rows:
            yield batch(rows)

    return src.mapInArrow(run, schema)
