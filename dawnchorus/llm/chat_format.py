"""Chat transcripts as training text that a deterministic parser reads back exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.shared import mapped

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_MARK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Break every control opening by one more backslash; ``unescape`` takes one away."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_MARK.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role and text as written, and where the text begins and ends.

    Grammar: ``turns = { START role "\\n" text END "\\n" }``, where a role has no line end and neither
    role nor text holds a control string. Anything else is an error.
    """
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"turn expected at {at}")
        begin = formatted.find("\n", at)
        end = formatted.find(END, begin + 1)
        if begin < 0 or end < 0 or not formatted.startswith("\n", end + len(END)):
            raise ValueError(f"open turn at {at}")
        role, text = formatted[at + len(START) : begin], formatted[begin + 1 : end]
        if any(mark in part for mark in (START, END) for part in (role, text)):
            raise ValueError(f"control string inside the turn at {at}")
        turns.append((role, text, begin + 1, end))
        at = end + len(END) + 1
    return turns


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape_role(role), unescape(text)) for role, text, _, _ in parse(formatted)]


def format_turn(role: str, text: str) -> str:
    """One turn; what does not read back identically is escaped until it does."""
    shown_role, shown_text = role, text
    while True:
        try:
            [(back_role, back_text)] = read_back(render(shown_role, shown_text))
        except ValueError:
            back_role, back_text = None, None
        if back_role == role and back_text == text:
            return render(shown_role, shown_text)
        if shown_role == role and shown_text == text:
            if back_text != text:
                shown_text = escape(text)
            if back_role != role:
                shown_role = escape_role(role)
        elif (shown_role, shown_text) != (escape_role(role), escape(text)):
            shown_role, shown_text = escape_role(role), escape(text)
        else:
            raise ValueError("turn cannot be told apart from its template")


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = TRAINED_ROLE,
) -> DataFrame:
    """Every turn in its template: (conversation, turn, formatted, loss_start, loss_chars).

    General: the project itself has no dialogues. A turn's place in its conversation's output is its
    order by ``turn``; the output of a conversation is its turns' ``formatted`` one after another.
    ``loss_start`` and ``loss_chars`` (code points within ``formatted``) cover the text of the turns to
    be learned; null and 0 otherwise. Turns are rendered, parsed and compared one by one, so a
    conversation of any length is spread over tasks; a control string cannot arise across two turns, as
    each begins and ends with a whole one.

    A null role or text counts as empty; keys may be null or repeated; further columns are ignored.
    """
    kinds = [turns.schema[c].dataType.simpleString() for c in (conversation, turn)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, starts, sizes = [], [], []
            for who, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                piece = format_turn(who or "", said or "")
                [(_, _, begin, end)] = parse(piece)
                learned = who == trained_role
                shown.append(piece)
                starts.append(begin if learned else None)
                sizes.append(end - begin if learned else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(shown, pa.string()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                names=["conversation", "turn", "formatted", "loss_start", "loss_chars"],
            )

    schema = f"conversation {kinds[0]}, turn {kinds[1]}, formatted string, loss_start long, loss_chars long"
    return mapped(turns.select(conversation, turn, role, text), run, schema)


class _Reading:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, size: int) -> None:
        self.chars += len(piece)
        for who, said in read_back(piece):
            self.turns += 1
            self.all.update(f"{who}\n{said}\n".encode())
        if start is not None:
            learned = unescape(piece[start : start + size])
            self.loss += len(learned)
            self.learned.update(learned.encode())

    def row(self) -> tuple[int, str, int, str, int]:
        return self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def read_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted output says, read back from it: one row per conversation.

    Takes the rows of ``format_conversations`` and returns ``conversation``, ``n_turns``,
    ``turns_sha256`` (role, line end, text, line end of each turn), ``loss_chars``, ``loss_sha256`` (the
    text under the loss mask, unescaped) and ``formatted_chars``. Turns of equal number are ordered
    by their formatted text. Conversations stream through sorted partitions: a digest is taken in order, so
    one conversation is one task's work, but only one turn of it is in memory.
    """
    kind = formatted.schema["conversation"].dataType
    ordered = formatted.repartition("conversation").sortWithinPartitions("conversation", "turn", "formatted")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reading = None, None
        for batch in batches:
            done: list[tuple] = []
            keys = batch.column(0).to_pylist()
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            for key, piece, start, size in zip(keys, *columns, strict=True):
                if reading is None or key != current:
                    if reading is not None:
                        done.append((current, *reading.row()))
                    current, reading = key, _Reading()
                reading.add(piece, start, size)
            yield _digests(done, batch.schema.field(0).type, names, types)
        if reading is not None:
            yield _digests([(current, *reading.row())], key_type(kind), names, types)

    schema = (
        f"conversation {kind.simpleString()}, n_turns long, turns_sha256 string, "
        "loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return mapped(ordered, run, schema)


def key_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _digests(rows: list[tuple], key: pa.DataType, names: list[str], types: list) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], key)]
    columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate(types, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["conversation", *names])


def conversation_digests(turns: DataFrame, **columns: str) -> DataFrame:
    """Format conversations and read them back (see the two steps)."""
    return read_conversations(format_conversations(turns, **columns)).where(F.col("n_turns") > 0)
