"""Chat formatting: every assistant turn becomes an example of its own."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template: START role newline text END newline.
START, END = "<|im_start|>", "<|im_end|>"
# Bytes of finished examples a worker gathers before it hands them on.
FLUSH_CHARS = 4 << 20

EXAMPLES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("example", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType()),
    ]
)

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No `<|` is left: `<`, any number of backslashes and `|` get one more backslash."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """Undo `escape`."""
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line: backslashes and line ends are written with a backslash."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    """Undo `escape_role`."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, the escaped text, and what ends it."""
    return f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((unescape_role(role), unescape(text.removesuffix("\n").removesuffix(END))))
    return turns


def _ordered(turns: DataFrame) -> DataFrame:
    """Each conversation in one partition, its turns in order; conversations whole and apart.

    Turns with the same number are ordered by role and text, so a result never depends on
    where rows came from.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def expand(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One example for each turn of `trained_role`: all turns before it as context, then it.

    `turns` has conv_id, turn, role and text. `formatted` is the whole example, and only the
    characters from loss_start up to loss_end (code points), the escaped reply, are trainable.
    Turns after a conversation's last reply, or a conversation without any, give a closing
    example with nothing trainable (both null), so that every turn can be read back.
    `example` counts from 0 in each conversation.

    Turns go through a worker one by one: it holds the text of one conversation, which is
    also its longest example, and never a list of turns. Null roles and texts are empty, a
    null turn number comes first, rows without conv_id form one conversation, repeated rows
    are turns of their own, an empty table gives no example, other columns are not looked at.
    Rows of a conversation are next to each other, in order of `example`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        conv: int | None = None
        context: list[str] = []
        size = number = 0
        open_turns = started = False

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv_id, role, text in zip(*columns):
                if started and conv_id != conv:
                    if open_turns:
                        out.append((conv, number, "".join(context), None, None))
                        chars += size
                    context, size, number, open_turns = [], 0, 0, False
                conv, started = conv_id, True
                before, body, after = format_turn(role, text)
                context += [before, body, after]
                if role == trained_role:
                    start = size + len(before)
                    context = ["".join(context)]
                    out.append((conv, number, context[0], start, start + len(body)))
                    number += 1
                    chars += len(context[0])
                size += len(before) + len(body) + len(after)
                open_turns = role != trained_role
                if chars >= FLUSH_CHARS:
                    yield _examples(out)
                    out, chars = [], 0
        if started and open_turns:
            out.append((conv, number, "".join(context), None, None))
        yield _examples(out)

    return _ordered(turns).mapInArrow(run, EXAMPLES)


def _examples(rows: list[tuple]) -> pa.RecordBatch:
    whole = pa.int64()
    types = [whole, whole, pa.string(), whole, whole]
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=EXAMPLES.names
    )


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_examples", T.LongType()),
    ]
)


def digests(examples: DataFrame) -> DataFrame:
    """Read the examples of `expand` back, one row per conversation.

    n_turns and turns_sha256 come from the turns parsed out of the last example, the loss
    columns from the unescaped text under every example's mask, formatted_chars is the sum
    over all its examples. Takes the rows as `expand` returns them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, started = None, "", False
        loss, loss_chars, chars, count = hashlib.sha256(), 0, 0, 0
        done: list[tuple] = []

        def close() -> None:
            turns = parse(last)
            told = hashlib.sha256()
            for role, text in turns:
                told.update(f"{role}\n{text}\n".encode())
            done.append(
                (conv, len(turns), told.hexdigest(), loss_chars, loss.hexdigest(), chars, count)
            )

        for batch in batches:
            for conv_id, formatted, start, end in zip(
                *(
                    batch.column(c).to_pylist()
                    for c in ("conv_id", "formatted", "loss_start", "loss_end")
                )
            ):
                if started and conv_id != conv:
                    close()
                    loss, loss_chars, chars, count = hashlib.sha256(), 0, 0, 0
                conv, last, started = conv_id, formatted, True
                if start is not None:
                    text = unescape(formatted[start:end])
                    loss.update(text.encode())
                    loss_chars += len(text)
                chars += len(formatted)
                count += 1
            yield _digests(done)
            done.clear()
        if started:
            close()
        yield _digests(done)

    return examples.mapInArrow(run, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string() if "sha256" in name else pa.int64() for name in DIGESTS.names]
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=DIGESTS.names
    )
