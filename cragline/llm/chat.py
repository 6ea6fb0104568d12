"""Chat formatting with a grammar round trip.

    conversation := "<chat escape=" LEVEL ">\n" turn*
    turn         := "### " role ": " text "</turn>\n"

A text ends at the first ``</turn>`` and holds no ``### ``. At level 0 roles and texts stand as they are. The rendered
text is parsed again; if the turns that come back are not the source's, the conversation is rendered at level 1, where a
backslash stands before each backslash and each ``#``, ``</turn>`` becomes ``<\\/turn>``, and in roles a colon and a line
break are escaped too. Level 1 reads back identically for any text; should it not, an error is raised.

Rows are dealt by conversation and sorted by turn, then read as a stream: a task holds the conversation that it
formats, and nothing else. A conversation becomes one string, so its turns must meet in one task.

Defined results: null text or role is empty; null conversation ids form one conversation; turns of equal number are
ordered by role and text, null turns first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]

#: The marks of the template.
OPEN, CLOSE = "### ", "</turn>"
HEAD = {0: re.compile(r"### ([^:\n]*): "), 1: re.compile(r"### ((?:[^:\n\\]|\\.)*): ", re.S)}
FORMATTED = (
    "conv_id long, n_turns long, escape_level int, formatted string, mask_start array<long>, mask_end array<long>"
)


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    return text.replace("\\", "\\\\").replace("#", "\\#").replace(CLOSE, "<\\/turn>")


def escape_role(role: str, level: int) -> str:
    return role if level == 0 else escape(role, level).replace(":", "\\:").replace("\n", "\\n").replace("\r", "\\r")


def unescape(text: str, level: int, role: bool = False) -> str:
    if level == 0 or "\\" not in text:
        return text
    named = {"n": "\n", "r": "\r"} if role else {}
    return re.sub(r"\\(.)", lambda m: named.get(m[1], m[1]), text, flags=re.S)


def render(turns: Turns, level: int) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of assistant texts in it."""
    parts, spans = [f"<chat escape={level}>\n"], []
    at = len(parts[0])
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role, level)}: ", escape(text, level)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def parse(formatted: str) -> tuple[int, Turns] | None:
    """(level, turns), or None if the text is not of the grammar."""
    if not (head := re.match(r"<chat escape=([01])>\n", formatted)):
        return None
    level, at, turns = int(head[1]), head.end(), []
    while at < len(formatted):
        turn = HEAD[level].match(formatted, at)
        end = formatted.find(CLOSE, turn.end()) if turn else -1
        if end < 0 or formatted[end + len(CLOSE)] != "\n" or OPEN in (text := formatted[turn.end() : end]):
            return None
        turns.append((unescape(turn[1], level, role=True), unescape(text, level)))
        at = end + len(CLOSE) + 1
    return level, turns


def format_turns(turns: Turns) -> tuple[str, list[tuple[int, int]], int]:
    """Text, mask and level: the lowest level at which parsing gives the source back."""
    for level in (0, 1):
        text, spans = render(turns, level)
        if parse(text) == (level, turns):
            return text, spans, level
    raise ValueError("the template does not read back")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turns]]:
    """Whole conversations from rows that come by conversation and turn."""
    key, turns, begun = None, [], False
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for conv, role, text in zip(*columns, strict=True):
            if begun and conv != key:
                yield key, turns
                turns = []
            key, begun = conv, True
            turns.append((role, text))
    if begun:
        yield key, turns


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation, as FORMATTED; mask_start and mask_end are code points of the assistant texts."""
    dealt = (
        rows.select(
            F.col(conv_col).cast("long").alias("conv"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(turn_col).alias("turn"),
        )
        .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FORMATTED.split(", ")]
        for conv, turns in _conversations(batches):
            text, spans, level = format_turns(turns)
            values = (conv, len(turns), level, text, [a for a, _ in spans], [b for _, b in spans])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    return dealt.mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back and digests turns and loss texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                level, turns = parse(row["formatted"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(
                    unescape(row["formatted"][a:b], level) for a, b in zip(row["mask_start"], row["mask_end"], strict=True)
                )
                out.append(
                    {
                        "conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
                        "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(row["formatted"]), "escape_level": row["escape_level"],
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escape_level")
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escape_level int"
    return formatted.mapInArrow(run, ddl)


#: Conversation -7 says the template's own marks, already escaped in part.
TRAP = r"\### Assistant: </turn> ok"


def op5(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(trap)))


#: In DuckDB: level 1 is taken where level 0 would not read back, which is where a text holds a mark, or a role a colon
#: or a line break.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), conflicts AS (
  SELECT *, (contains(text, '</turn>') OR contains(text, '### ') OR contains(role, ':') OR contains(role, chr(10)))::INT AS conflict FROM rows
), grouped AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         max(conflict)::INT AS level,
         sum(length(role) + length(text))::BIGINT AS raw_chars,
         sum(length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'))
           + length(replace(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:'), chr(10), '\n')))::BIGINT AS escaped_chars
  FROM conflicts GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (16 + n_turns * 14 + CASE WHEN level = 1 THEN escaped_chars ELSE raw_chars END)::BIGINT AS formatted_chars, level AS escape_level
FROM grouped
"""
