"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.  A deterministic parser reads rendered text back; when
the turns it recovers are not the source turns, the conflicting content is escaped and rendered again until they are.
A control string gets one backslash after ``<|`` (``<|\\im_end|>``), one that already has backslashes gets one more,
and the parser takes one away, so escaping is reversible.  A role's newlines are escaped in the same way (``<|\\n|>``).

Turns are rendered one by one, so a conversation of any length is spread over many tasks.  The loss mask of a turn is
the span of its text when the role is ``assistant``, and empty otherwise.

Null text and null role are empty.  Rows of a conversation are ordered by turn (null first), equal turns by their
rendered text; repeated rows are turns of their own.  A null conv_id is one conversation.  An empty table gives no
rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end|n)\|>")


def escape(content: str) -> str:
    """One more backslash in every control string, at any depth."""
    return _CONTROL.sub(lambda m: f"<|\\{m[1]}{m[2]}|>", content)


def unescape(content: str) -> str:
    """One backslash less; ``<|n|>`` without one is a newline of a role."""
    return _CONTROL.sub(lambda m: f"<|{m[1][1:]}{m[2]}|>" if m[1] else "\n" if m[2] == "n" else m[0], content)


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


class Parser:
    """Reads rendered text piece by piece and gives the turns that are complete.

    grammar: conversation = turn*; turn = START role NEWLINE text END NEWLINE, where neither role nor text holds an
    unescaped control string and role holds no newline.
    """

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.rest += piece
        turns = []
        while (end := self.rest.find(END + "\n")) >= 0:
            if not self.rest.startswith(START):
                raise ValueError("a turn does not begin with its start mark")
            role, line, text = self.rest[len(START) : end].partition("\n")
            if not line or START in text or START in role or END in text or END in role:
                raise ValueError("a turn has no role line or holds a control string")
            turns.append((unescape(role), unescape(text)))
            self.rest = self.rest[end + len(END) + 1 :]
        return turns

    def close(self) -> None:
        if self.rest:
            raise ValueError("text after the last turn")


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of ``formatted``, or None when it is not a sentence of the grammar."""
    reader = Parser()
    try:
        turns = reader.feed(formatted)
        reader.close()
    except ValueError:
        return None
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and its text's span in it, after as many escapes as the round trip asks for."""
    shown_role, shown_text = role, text
    for _ in range(4):
        out = render(shown_role, shown_text)
        if parse(out) == [(role, text)]:
            start = len(START) + len(shown_role) + 1
            return out, start, start + len(shown_text)
        shown_role, shown_text = escape(role).replace("\n", "<|n|>"), escape(text)
    raise AssertionError("escaping did not reach a fixed point")


def format_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) rendered one by one: conv_id, turn, formatted, loss_start, loss_end."""
    narrow = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), rows["role"].alias("role"), rows["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, starts, ends = [], [], []
            for role, text in zip(batch.column(2), batch.column(3), strict=True):
                role = role.as_py() or ""
                out, start, end = format_turn(role, text.as_py() or "")
                formatted.append(out)
                starts.append(start)
                ends.append(end if role == "assistant" else start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_end"],
            )

    return narrow.mapInArrow(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def format_conversations(rows: DataFrame) -> DataFrame:
    """One text per conversation with its loss spans (code points), for conversations that fit a row."""
    turns = format_turns(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "formatted", "loss_start", "loss_end"))).alias("t"))
    before = F.transform("t", lambda x, i: F.aggregate(F.slice("t", 1, i), F.lit(0).cast("long"), lambda s, y: s + F.length(y["formatted"])))
    spans = F.zip_with("t", before, lambda x, b: F.struct((x["loss_start"] + b).alias("start"), (x["loss_end"] + b).alias("end")))
    return turns.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"),
        F.filter(spans, lambda s: s["end"] > s["start"]).alias("loss_spans"),
    )


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, digests of what the parser recovers from the rendered turns and their loss spans.

    The turns of a conversation stream through one task in order, a turn at a time; nothing is gathered.
    """
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, state = None, None

        def close() -> None:
            reader, all_turns, masked, count, chars, total = state
            reader.close()
            done.append((conv, count, all_turns.hexdigest(), chars, masked.hexdigest(), total))

        for batch in batches:
            for key, piece, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        close()
                    conv, state = key, [Parser(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, text in state[0].feed(piece):
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[3] += 1
                masked = unescape(piece[start:end])
                state[2].update(masked.encode())
                state[4] += len(masked)
                state[5] += len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
