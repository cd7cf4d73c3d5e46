"""Chat formatting with typed content parts.

A message's content is a list of parts (kind, text, ref, width, height, seconds, pages).  A visitor flattens the parts
of a turn in order: text as it is, every attachment as one placeholder that names its kind and number, while its
reference and the number of tokens it expands to are recorded beside the output.  Each turn is one chunk of the
training text, so turns are formatted in parallel; a conversation is its chunks in order.

Template: `<s>[ROLE] role [/ROLE] body </s>` with control strings `CONTROL`.  Inside a body, a control string or a
backslash gets a backslash before it; `read_back` undoes this exactly.  Every control string begins with `<` or `[` and
has neither later on, so none can arise where a body meets the template.  The loss mask covers the texts of assistant
turns.

Defined results: turns are ordered by turn (nulls first), then role, then body as it is before escaping, by their bytes,
so repeated rows follow each other and all count; a null text or an empty list of parts is an empty body; a null role is
the empty role; a null conv_id is a
conversation of its own.  An unknown part kind is a document; a null measure counts as the least: one patch, one audio
frame, one page.  Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PLACEHOLDERS = ("image", "audio", "document")
CONTROL = (
    "<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<|image|>", "<|audio|>", "<|document|>", "<|end|>",
)
PATCH, FRAME_SECONDS, PAGE_TOKENS = 14, 0.04, 256
PARTS_DDL = "array<struct<kind string, text string, ref string, width int, height int, seconds double, pages int>>"
CHUNK_DDL = (
    "conv_id long, turn long, role string, chunk string, "
    "attachments array<struct<kind string, ref string, tokens long>>, expanded_tokens long"
)

_CONTROL = "|".join(re.escape(c) for c in CONTROL)
_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_TOKEN = re.compile(rf"(?s)\\.|{_CONTROL}")
_UNESCAPE = re.compile(r"(?s)\\(.)")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class PartVisitor:
    """Collects the body, the attachments and their tokens of one turn's parts."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        getattr(self, f"visit_{kind}" if kind in ("text", *PLACEHOLDERS) else "visit_document")(part)

    def visit_text(self, part: dict) -> None:
        self.body.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil((part.get(x) or 0) / PATCH)) for x in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) / FRAME_SECONDS)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.body.append(f"<|{kind}|>{len(self.attachments) - 1}<|end|>")


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, list[dict]]:
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    return f"<s>[ROLE]{escape(role or '')}[/ROLE]{''.join(visitor.body)}</s>", visitor.attachments


def read_back(chunks: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Turns of formatted text: (role, pieces), a piece being ("text", unescaped text) or (kind, attachment number)."""
    role, pieces, at, opened = "", [], 0, None
    for m in _TOKEN.finditer(chunks):
        token = m[0]
        if token[0] == "\\":
            continue
        before, at = chunks[at:m.start()], m.end()
        if token == "[/ROLE]":
            role = unescape(before)
        elif token.startswith("<|") and token != "<|end|>":
            if before:
                pieces.append(("text", unescape(before)))
            opened = token[2:-2]
        elif token == "<|end|>":
            pieces.append((opened, before))
        elif token == "</s>":
            if before:
                pieces.append(("text", unescape(before)))
            yield role, pieces
            role, pieces = "", []


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("chunk", pa.string()),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
        ("expanded_tokens", pa.int64())])
    for batch in batches:
        made = [format_turn(r, p or []) for r, p in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
        yield pa.record_batch([
            batch.column("conv_id"), batch.column("turn"), batch.column("role").cast(pa.string()),
            pa.array([c for c, _ in made], pa.string()), pa.array([a for _, a in made], schema.field("attachments").type),
            pa.array([sum(x["tokens"] for x in a) for _, a in made], pa.int64())], schema=schema)


def text_parts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) of plain text turns."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), *empty)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.array(part).alias("parts"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn of `turns` (conv_id, turn, role, parts): its chunk of training text and its attachments."""
    return turns.select("conv_id", "turn", "role", F.col("parts").cast(PARTS_DDL).alias("parts")).mapInArrow(format_batches, CHUNK_DDL)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads sorted chunks back, one conversation after the other, in constant memory."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    conv, state, done = object(), None, []

    def close() -> None:
        if state is not None:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

    for batch in batches:
        for c, chunk, attached, tokens in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "chunk", "n_attachments", "expanded_tokens")), strict=True):
            if state is None or c != conv:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, pieces in read_back(chunk):
                text = "".join(x for kind, x in pieces if kind == "text")
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    state[2] += len(text)
                    state[3].update(text.encode())
            state[4] += len(chunk)
            state[5] += attached
            state[6] += tokens
        if done:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], schema=schema)
            done = []
    close()
    if done:
        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)], schema=schema)


def conversation_digests(chunks: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says when read back: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_attachments, expanded_tokens).

    A digest is sequential, so one conversation is read by one task, chunk by chunk: nothing of it is gathered.
    """
    body = F.regexp_replace(F.expr("left(chunk, length(chunk) - 4)"), r"(?s)\\(.)", "$1")  # turns of one role differ in their bodies only
    dealt = chunks.select("conv_id", "turn", "role", "chunk", F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens")
    return (
        dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), body)
        .select("conv_id", "chunk", "n_attachments", "expanded_tokens")
        .mapInArrow(digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
    )
