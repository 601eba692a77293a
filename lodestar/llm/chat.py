"""Chat formatting: typed content parts become one text with ordered placeholders.

A turn is ``### role: content </turn>`` and a line end. Inside texts and roles
``\\``, ``#``, ``<`` and ``:`` (roles only) are preceded by ``\\``, so that no text can
spell a control string, and the text comes back unchanged. Formatting looks at one
turn at a time; only the digest of a conversation reads its turns in order, as a
stream, without ever holding a conversation.
"""

from __future__ import annotations

import hashlib
import re
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "array<struct<kind:string,text:string,ref:string,units:double>>"

# Tokens that a part takes besides its text, for each unit of it
# (an image's tiles, an audio's seconds, a document's pages), and at least.
EXPANSION = {"image": (170, 85), "audio": (25, 25), "document": (600, 600)}

#: Possessive, so that a malformed turn is given up in one pass; the text takes the space before the mark with it.
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<[a-z]+:\d+>)*+)</turn>\n", re.DOTALL)
_PLACE = re.compile(r"\\.|<[a-z]+:\d+>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"([\\#<:])" if role else r"([\\#<])", r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Flatten:
    """Visits the parts of one turn in order; ``text`` is what they become."""

    def __init__(self, learned: bool):
        self.learned, self.pieces, self.length = learned, [], 0
        self.attachments: list[dict] = []
        self.loss: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("kind")
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit_text(self, part: dict) -> None:
        piece = escape(part.get("text") or "")
        if self.learned and piece:
            self.loss.append({"start": self.length, "stop": self.length + len(piece)})
        self._add(piece)

    def _attach(self, part: dict) -> None:
        kind, number = part["kind"], len(self.attachments)
        each, least = EXPANSION[kind]
        tokens = max(least, ceil(each * max(part.get("units") or 0.0, 0.0)))
        self.attachments.append({"number": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self._add(f"<{kind}:{number}>")

    visit_image = visit_audio = visit_document = _attach

    def visit_other(self, part: dict) -> None:
        """Parts of an unknown kind count as text."""
        self.visit_text(part)


def format_turn(role: str | None, text: str | None, parts: list[dict] | None, learned_role: str = "assistant") -> dict:
    """One turn: its text, and what is under the loss mask (places in that text)."""
    visitor = Flatten(role == learned_role)
    for part in [{"kind": "text", "text": text}] if parts is None else parts:
        visitor.visit(part or {})
    head = f"### {escape(role or '', True)}: "
    return {
        "formatted": f"{head}{''.join(visitor.pieces)} </turn>\n",
        "loss": [{k: v + len(head) for k, v in span.items()} for span in visitor.loss],
        "attachments": visitor.attachments, "expanded_tokens": sum(a["tokens"] for a in visitor.attachments),
    }


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn, placeholders left out."""
    found = _TURN.fullmatch(formatted)
    if not found or not found[2].endswith(" "):
        raise ValueError("not a formatted turn")
    text = _PLACE.sub(lambda m: m[0][1] if m[0][0] == "\\" else "", found[2][:-1])
    return unescape(found[1]), text


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turns(conversations: DataFrame, parts: str | None = None) -> DataFrame:
    """Format each row of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``).

    ``parts`` names a column of typed parts (see ``PART``) that replaces ``text`` where
    it is not NULL. Returns ``conv_id``, ``turn``, ``role``, ``formatted``, ``loss`` (spans
    of code points of ``formatted``: each text of an assistant), ``attachments`` (in
    the order of their placeholders) and ``expanded_tokens``.

    NULL texts and roles are empty. A part of unknown kind counts as text; an
    attachment without units takes its least number of tokens. Rows are formatted
    each for itself, repeated or not; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            out = [format_turn(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("role", "text", "parts")))]
            pick = lambda name, kind: pa.array([row[name] for row in out], kind)
            yield pa.record_batch({
                "conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "role": batch.column("role"), "formatted": pick("formatted", pa.string()),
                "loss": pick("loss", _SPANS), "attachments": pick("attachments", _ATTACHED), "expanded_tokens": pick("expanded_tokens", pa.int64()),
            })

    content = F.lit(None).cast(PART) if parts is None else F.col(parts).cast(PART)
    taken = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), content.alias("parts"))
    name = taken.schema["conv_id"].dataType.simpleString()
    return taken.mapInArrow(run, f"conv_id {name}, turn long, role string, formatted string, loss array<struct<start:long,stop:long>>, attachments array<struct<number:long,kind:string,ref:string,tokens:long>>, expanded_tokens long")


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        role, text = parse_turn(formatted)
        self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            learned = unescape(formatted[span["start"] : span["stop"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.turns += 1
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read formatted turns back: one row a conversation.

    Turns are read in the order of ``turn`` (NULL first), then of their text, so
    that ties have one order. Rows without conv_id are one conversation.
    """
    name = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv_id, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(formatted, loss)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, batch.schema.field("conv_id").type) for i, x in enumerate(zip(*done))], names)
            kind = batch.schema.field("conv_id").type
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) if not i else pa.array([x]) for i, x in enumerate(now.row())], names)

    ordered = turns.select("conv_id", "turn", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, f"conv_id {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
