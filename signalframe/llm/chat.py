"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Rendering the
successive prefixes of a conversation and comparing consecutive outputs locates
the span that each turn added; where an output doesn't begin with the one before
it, the template rewrites history, and the row says so instead of giving spans
that would be wrong. The spans of the trained role, less the markers around the
text, form the loss mask.

``TEMPLATE`` is append-only. It marks turns with control strings and escapes every
character in roles and texts that could begin one, so whatever a text says, the
turns can be read back from the output alone (``read_back``).

Rows become conversations by a shuffle on the conversation and a sort by turn; a
task streams through them and holds one conversation at a time.

Defined cases: null texts and roles are empty; turns with equal numbers are taken
in order of role and text, those without a number last; rows without a
conversation id form one conversation of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import shuffle_partitions

Turn = tuple[str, str]
BATCH_ROWS = 256

#: The control strings of the template, before and behind the text of each role.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>"), "system": ("<<SYS>> ", " <</SYS>>")}
BEGIN = "<s>"
OTHER = ("[ROLE=", "] ", " [/ROLE]")
ESCAPED = re.compile(r"[\\\[\]<]")
TURN = re.compile(r"\[INST\] (?P<user>(?:[^\\\[\]<]|\\.)*) \[/INST\]|\[OUT\] (?P<assistant>(?:[^\\\[\]<]|\\.)*)</s>|<<SYS>> (?P<system>(?:[^\\\[\]<]|\\.)*) <</SYS>>|\[ROLE=(?P<role>(?:[^\\\[\]<]|\\.)*)\] (?P<other>(?:[^\\\[\]<]|\\.)*) \[/ROLE\]", re.DOTALL)


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked(role: str, text: str) -> str:
    """One turn as ``TEMPLATE`` writes it."""
    before, behind = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
    return f"{before}{escape(text)}{behind}"


def TEMPLATE(turns: list[Turn]) -> str:  # noqa: N802
    return BEGIN + "".join([marked(*turn) for turn in turns])


def remembering() -> Callable[[list[Turn]], str]:
    """``TEMPLATE`` for the prefixes of one conversation: a turn is escaped once, not again for each prefix."""
    pieces: dict[Turn, str] = {}

    def render(turns: list[Turn]) -> str:
        for turn in turns[-1:]:
            if turn not in pieces:
                pieces[turn] = marked(*turn)
        return BEGIN + "".join([pieces[turn] if turn in pieces else marked(*turn) for turn in turns])

    return render


def read_back(formatted: str) -> list[Turn]:
    """The turns, from the output of ``TEMPLATE`` alone."""
    at, turns = len(BEGIN), []
    while at < len(formatted):
        m = TURN.match(formatted, at)
        role = next(r for r in ("user", "assistant", "system", "other") if m[r] is not None)
        turns.append((unescape(m["role"]) if role == "other" else role, unescape(m[role])))
        at = m.end()
    return turns


def turn_spans(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int]], int | None]:
    """The rendered conversation, each turn's span in it, and the first turn (or None) that made the template rewrite what it had given before."""
    before = render([])
    spans = []
    for n in range(1, len(turns) + 1):
        now = render(turns[:n])
        if not now.startswith(before):
            return render(turns), [], n - 1
        spans.append((len(before), len(now)))
        before = now
    return before, spans, None


def loss_spans(formatted: str, spans: list[tuple[int, int]], turns: list[Turn], role: str = "assistant") -> list[tuple[int, int]]:
    """The parts of the spans of ``role`` that hold its texts, without the markers."""
    before, behind = MARKS[role]
    return [(a + len(before), b - len(behind)) for (a, b), (r, _) in zip(spans, turns, strict=True) if r == role]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, per_conversation: Callable[[object, list[Turn]], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """One row, as ``per_conversation`` makes it, for each conversation."""
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = rows.repartition(shuffle_partitions(df.sparkSession), "id").sortWithinPartitions("id", F.col("turn").asc_nulls_last(), "role", "text")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in it for line in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        held = []
        for key, group in groupby(lines, key=lambda line: line[0]):
            held.append(per_conversation(key, [(role, text) for _, role, text in group]))
            if len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return dealt.mapInArrow(work, schema)


def format_conversations(df: DataFrame, render: Callable[[list[Turn]], str] = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, the formatted text, the span of each turn and the first turn that rewrote history (null: none)."""
    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    span = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    arrow = pa.schema([("id", to_arrow_type(kind)), ("formatted", pa.string()), ("spans", pa.list_(span)), ("rewritten_at", pa.int64())])

    def one(key, turns):
        formatted, spans, rewritten = turn_spans(remembering() if render is TEMPLATE else render, turns)
        return {"id": key, "formatted": formatted, "spans": [{"role": r, "start": a, "end": b} for (a, b), (r, _) in zip(spans, turns, strict=False)], "rewritten_at": rewritten}

    schema = f"id {kind.simpleString()}, formatted string, spans array<struct<role: string, start: bigint, end: bigint>>, rewritten_at long"
    return conversations(df, id_col, turn_col, role_col, text_col, one, schema, arrow).withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What is read back from each formatted conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, history_rewritten."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    arrow = pa.schema([("id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("history_rewritten", pa.bool_())])

    def one(key, turns):
        formatted, spans, rewritten = turn_spans(remembering(), turns)
        back = read_back(formatted)
        loss = "".join(unescape(formatted[a:b]) for a, b in loss_spans(formatted, spans, back))
        return {"id": key, "n_turns": len(back), "turns_sha256": _digest("".join(f"{r}\n{t}\n" for r, t in back)), "loss_chars": len(loss), "loss_sha256": _digest(loss), "formatted_chars": len(formatted), "history_rewritten": rewritten is not None}

    schema = f"id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, history_rewritten boolean"
    return conversations(df, id_col, turn_col, role_col, text_col, one, schema, arrow).withColumnRenamed("id", id_col)
