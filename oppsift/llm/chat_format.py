"""Chat formatting: turns of typed content parts to one marked text, and back.

A visitor flattens the parts of a turn in order: text as it is, an image, sound or document as a placeholder, whose
reference and number of tokens it records. The template marks turns as

    <<SYS>>system<</SYS>>   [INST]user[/INST]   <s>assistant</s>   [ROLE]other role[TEXT]its text[/ROLE]

Control strings inside texts are escaped: in each, and in each that has backslashes after its first character, one more
backslash follows that character; taking one away gives the text back. The loss mask covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oppsift.llm.shared import arrow

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

_CONTROLS = sorted({*(m for pair in MARKS.values() for m in pair), *OTHER, *PLACEHOLDERS.values()}, key=len, reverse=True)
_ESCAPES = re.compile("|".join(f"(?:{re.escape(c[0])}\\\\*{re.escape(c[1:])})" for c in _CONTROLS))
_OPENS = re.compile("|".join(re.escape(m) for m in (*(a for a, _ in MARKS.values()), OTHER[0])))
_ENDS = {a: (role, b) for role, (a, b) in MARKS.items()}


def escape(text: str) -> str:
    return _ESCAPES.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPES.sub(lambda m: m[0][0] + m[0][1:].removeprefix("\\"), text)


@dataclass
class Flattener:
    """Visits the content parts of one turn."""

    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    #: Tokens that stand for one unit of an attachment: a tile of an image, a second of sound, a page of a document.
    per_unit: dict[str, int] = field(default_factory=lambda: {"image": 256, "audio": 25, "document": 512})

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, units: int) -> None:
        tokens = max(1, units) * self.per_unit[kind]
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "tokens": tokens, "at": sum(map(len, self.out))})
        self.out.append(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        """A tile is 512 pixels square."""
        self._attach("image", part, -(-(part.get("width") or 1) // 512) * -(-(part.get("height") or 1) // 512))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, -(-(part.get("millis") or 1) // 1000))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, part.get("pages") or 1)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"a content part of type {part.get('type')!r}")


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """The marked turn, the span of its loss mask (empty unless the assistant's) and its attachments, with places in it."""
    visitor = Flattener()
    for part in parts:
        visitor.visit(part)
    body = "".join(visitor.out)
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = OTHER[0] + escape(role or "") + OTHER[1], OTHER[2]
    for a in visitor.attachments:
        a["at"] += len(head)
    end = len(head) + len(body)
    return head + body + tail, len(head) if role == "assistant" else end, end, visitor.attachments


class Parser:
    """Reads turns back from pieces of a formatted text, as they come."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text, unescaped; placeholders stay) of each turn that is complete."""
        self.rest += piece
        at = 0
        while m := _OPENS.match(self.rest, at):
            if m[0] == OTHER[0]:
                mid = self.rest.find(OTHER[1], m.end())
                end = self.rest.find(OTHER[2], mid) if mid >= 0 else -1
                if end < 0:
                    break
                yield unescape(self.rest[m.end() : mid]), unescape(self.rest[mid + len(OTHER[1]) : end])
                at = end + len(OTHER[2])
            else:
                role, tail = _ENDS[m[0]]
                end = self.rest.find(tail, m.end())
                if end < 0:
                    break
                yield role, unescape(self.rest[m.end() : end])
                at = end + len(tail)
        self.rest = self.rest[at:]


ATTACHMENT = "struct<kind: string, ref: string, tokens: long, at: long>"
FORMATTED = f"conv_id long, turn long, formatted string, start long, loss_start long, loss_end long, tokens long, attachments array<{ATTACHMENT}>"
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string())]
    + [(n, pa.int64()) for n in ("start", "loss_start", "loss_end", "tokens")]
    + [("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())])))]
)
_MISSING = object()


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, start = _MISSING, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, start = row["conv_id"], 0
            text, a, b, attached = format_turn(row["role"], row["parts"] if row["parts"] is not None else [{"type": "text", "text": row["text"]}])
            shifted = [x | {"at": x["at"] + start} for x in attached]
            out.append({"conv_id": conv, "turn": row["turn"], "formatted": text, "start": start, "loss_start": start + a, "loss_end": start + b, "tokens": sum(x["tokens"] for x in attached), "attachments": shifted})
            start += len(text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each turn of ``turns`` (conv_id, turn, role, text, or parts in place of text), in order within each
    conversation: its piece of the conversation's formatted text, where that starts, the span of the loss mask (empty but for
    the assistant), the attachments with their places and numbers of tokens, and the sum of those.

    Rows go by turn, on ties by role and text; rows with a null turn come first. A null text is empty, a null role is an
    empty one, a null conv_id a conversation of its own; an empty table gives an empty result; other columns are ignored.
    A conversation streams through one task a row at a time, so its length is not bounded by memory.
    parts: array<struct<type, text, ref, width, height, millis, pages>>, of which type, text and ref suffice.
    """
    columns = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")] + [F.col("role")]
    columns.append(F.col("text") if "text" in turns.columns else F.lit(None).cast("string").alias("text"))
    columns.append(F.col("parts") if "parts" in turns.columns else F.lit(None).cast("array<struct<type: string, text: string, ref: string>>").alias("parts"))
    rows = turns.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.transform(arrow, _format, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = _MISSING
    state: dict = {}

    def row() -> dict:
        if state["parser"].rest:
            raise ValueError(f"conversation {conv}: a turn does not end")
        return {"conv_id": conv, "n_turns": state["turns"], "turns_sha256": state["all"].hexdigest(), "loss_chars": state["chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["size"]}

    def out(rows: list[dict]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip([x.split()[0] for x in DIGEST.split(", ")], kinds, strict=True))))

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["conv_id"] != conv:
                if conv is not _MISSING:
                    done.append(row())
                conv, state = r["conv_id"], {"parser": Parser(), "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
            state["size"] += len(r["formatted"])
            for role, text in state["parser"].feed(r["formatted"]):
                state["turns"] += 1
                state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(r["formatted"][r["loss_start"] - r["start"] : r["loss_end"] - r["start"]])
            state["chars"] += len(masked)
            state["loss"].update(masked.encode("utf-8", "surrogatepass"))
        if done:
            yield out(done)
    if conv is not _MISSING:
        yield out([row()])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the output of ``format_conversations`` says when read back, from wherever it lies and in whatever order: of each
    conversation its number of turns, the sha256 of role, line feed, text, line feed of all turns, the length and sha256 of what
    lies under the loss mask, unescaped, and the length of the formatted text."""
    rows = formatted.select("conv_id", "formatted", "start", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return rows.transform(arrow, _digest, DIGEST)


def oracle_sql() -> str:
    """The digests of the conversations table and of conversation -1 by SQL. An escape adds one character to each control string."""
    marks = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
    escapes = _ESCAPES.pattern.replace("'", "''")
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
m AS (SELECT *, length(text) + len(regexp_extract_all(text, '{escapes}')) + CASE role {marks} ELSE {sum(map(len, OTHER))} + length(role) + len(regexp_extract_all(role, '{escapes}')) END AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
