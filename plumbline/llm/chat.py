"""Chat formatting: conversations rendered by a compiled template, and read back.

Rows are dealt to ranges of (conversation, turn), so a conversation that holds a third of all turns
is rendered by many tasks, in runs of bounded length. Control strings inside roles and texts are
escaped reversibly: one backslash is put after their first character, and one more where backslashes
stand there already, so that no text can open or close a turn. The reader gets turns and the text
under the loss mask from the formatted text alone.

The digest of a conversation is a chain over all its text, which no two tasks can share: the runs
that were read are dealt by conversation and hashed in order as they stream by, never held together.

Defined cases: turns go by number, then role and text, nulls first; a null text or role is empty; a
repeated row is a turn of its own; a null conv_id is one conversation; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chat_template import Output, compile_nodes, split_at_messages

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat formats. None of them may appear in a formatted text by way of a message.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{# one block per turn; the model learns what the assistant says #}"
    "{% for message in messages %}"
    "{{ '<|im_start|>' ~ (message.role | field) ~ '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}"
    "{% endfor %}"
)
#: Code points of a run of turns. A longer turn is a run of its own.
RUN_CHARS = 1_000_000

_PLAIN = re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)


def escape(text: object) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", str(text or ""))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def escape_field(text: object) -> str:
    """One line: line breaks are written as ``\\n``, a backslash as two."""
    return escape(str(text or "").replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_field(text: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


FILTERS = {"escape": escape, "field": escape_field, "trim": lambda v: str(v or "").strip(), "lower": lambda v: str(v or "").lower(), "upper": lambda v: str(v or "").upper()}

RUNS = "conv_id bigint, part int, run int, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, run_chars: int = RUN_CHARS) -> DataFrame:
    """Runs of formatted turns: text and generation spans, in order of (``part``, ``run``) within a conversation.

    What the template has before and after its loop over messages is not part of the runs, see ``frame``."""
    _, variable, body, _ = split_at_messages(template, FILTERS)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = compile_nodes(body, FILTERS)
        part, run, conv, out = TaskContext.get().partitionId(), 0, None, Output()

        def row() -> dict:
            starts, ends = zip(*out.spans) if out.spans else ((), ())
            return {"conv_id": conv, "part": part, "run": run, "formatted": out.text(), "loss_starts": list(starts), "loss_ends": list(ends)}

        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if out.length and (conv_id != conv or out.length >= run_chars):
                    rows.append(row())
                    run, out = run + 1, Output()
                conv = conv_id
                turn({variable: {"role": role or "", "text": text or ""}}, out)
            yield pa.RecordBatch.from_pylist(rows, schema=_RUNS)
        if out.length:
            yield pa.RecordBatch.from_pylist([row()], schema=_RUNS)

    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("bigint"), "turn", "role", "text")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(render, RUNS)


_RUNS = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))]
)


def frame(template: str = TEMPLATE) -> tuple[str, str]:
    """What a conversation's text has before its first and after its last turn."""
    texts = []
    before, _, _, after = split_at_messages(template, FILTERS)
    for nodes in (before, after):
        out = Output()
        compile_nodes(nodes, FILTERS)({}, out)
        texts.append(out.text())
    return texts[0], texts[1]


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside a turn")
        found.append((unescape_field(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside a turn")
    return found


def read_back(runs: DataFrame) -> DataFrame:
    """What the formatted runs say: ``turns`` (role, line break, text, line break of each, as bytes),
    ``n_turns``, ``loss`` (the unescaped text under the mask, as bytes), ``loss_chars``, ``chars``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, part, run, formatted, starts, ends in zip(*[c.to_pylist() for c in batch.columns]):
                turns = read_turns(formatted)
                learned = "".join([unescape(formatted[a:b]) for a, b in zip(starts, ends)])
                said = "".join([f"{role}\n{text}\n" for role, text in turns])
                rows.append(
                    {"conv_id": conv, "part": part, "run": run, "turns": said.encode(), "n_turns": len(turns), "loss": learned.encode(), "loss_chars": len(learned), "chars": len(formatted)}
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return runs.mapInArrow(read, "conv_id bigint, part int, run int, turns binary, n_turns bigint, loss binary, loss_chars bigint, chars bigint")


_READ = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("turns", pa.binary()), ("n_turns", pa.int64()), ("loss", pa.binary()), ("loss_chars", pa.int64()), ("chars", pa.int64())]
)
_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def conversation_digests(read: DataFrame, framed_chars: int = 0) -> DataFrame:
    """One row per conversation: counts and SHA-256 digests of the turns and of the learned text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, now = none, {}
        turns = loss = None

        def row() -> dict:
            return now | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        for batch in batches:
            rows = []
            for conv_id, said, n, learned, learned_chars, chars in zip(*[c.to_pylist() for c in batch.columns]):
                if conv is none or conv_id != conv:
                    if conv is not none:
                        rows.append(row())
                    conv, turns, loss = conv_id, hashlib.sha256(), hashlib.sha256()
                    now = {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": framed_chars}
                turns.update(said)
                loss.update(learned)
                now["n_turns"] += n
                now["loss_chars"] += learned_chars
                now["formatted_chars"] += chars
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGESTS)
        if conv is not none:
            yield pa.RecordBatch.from_pylist([row()], schema=_DIGESTS)

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "part", "run")
    return ordered.select("conv_id", "turns", "n_turns", "loss", "loss_chars", "chars").mapInArrow(
        digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
