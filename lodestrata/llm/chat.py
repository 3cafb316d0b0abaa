"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as `<s>role\\ntext</s>\\n`. The rendered conversation is parsed again by a deterministic
parser. Turns whose recovered role and text differ from the source are rendered anew as `<s!>role\\ntext</s>\\n` with the conflicting
content escaped, and the conversation is parsed again, until all its turns are identical. The grammar lets no control string
stand bare inside a role or text, so such a turn differs, too.

Escaping puts a backslash before each backslash and before the first character of each control string; a role's line
feeds become `\\n`. A turn that still differs has all its characters escaped. Reading drops the backslashes, so it is reversible.

Rows go to tasks by conversation and stream through in order. A long conversation is rendered and parsed batch by batch, which gives
the same as at once, as the parser reads from left to right and looks at nothing beyond a turn's end mark. So a conversation of any
length needs the memory of one batch; its digests run over its turns in order, so it is one task's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import batches

CONTROL = ("<s>", "<s!>", "</s>", "[INST]", "[/INST]")
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURNS = "conv_id long, turn long, role string, text string, formatted string, read_role string, read_text string"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_CONFLICT = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str, role: bool = False) -> str:
    text = _CONFLICT.sub(lambda m: "\\" + m[0], text)
    return text.replace("\n", "\\\n") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str, at: int = 0) -> tuple[str, str, int] | None:
    """The turn that begins at `at`: role, text and where the next begins; None if there is none.

    A plain turn's role ends at the first line feed and its text at the first control string, which is the end mark. In an
    escaped turn a backslash takes the character after it out of the grammar.
    """
    if formatted.startswith("<s>", at):
        line, end = formatted.find("\n", at), _CONTROL.search(formatted, at + 3)
        if not end or not at < line < end.start() or not formatted.startswith("</s>\n", end.start()):
            return None
        return formatted[at + 3 : line], formatted[line + 1 : end.start()], end.start() + 5
    if not formatted.startswith("<s!>", at):
        return None
    line = _bare(formatted, "\n", at + 4)
    end = _bare(formatted, "</s>\n", line + 1) if line >= 0 else -1
    if end < 0:
        return None
    return unescape(formatted[at + 4 : line]), unescape(formatted[line + 1 : end]), end + 5


def _bare(text: str, mark: str, at: int) -> int:
    """Where `mark` first stands with no escape before it."""
    found = text.find(mark, at)
    while found >= 0:
        slash = text.find("\\", at, found)
        if slash < 0:
            return found
        at = slash + 2
        if at > found:
            found = text.find(mark, at)
    return -1


def render(role: str, text: str, level: int = 0) -> str:
    """One turn: plain, with what conflicts escaped (level 1) or with every character escaped (level 2)."""
    if level == 0:
        return f"<s>{role}\n{text}</s>\n"
    if level == 1:
        return f"<s!>{escape(role, True)}\n{escape(text)}</s>\n"
    return "<s!>" + "".join("\\" + c for c in role) + "\n" + "".join("\\" + c for c in text) + "</s>\n"


def round_trip(turns: list[tuple[str, str]]) -> tuple[list[str], list[tuple[str, str]]]:
    """The turns (role, text) as rendered, and what the parser reads from the rendered conversation: the same turns.

    Behind a turn that differs the parser goes on where the next one was rendered, so one pass names all that differ. In the
    last pass none does, and each turn is read where the parser left the one before it.
    """
    shown, levels = [render(*turn) for turn in turns], [0] * len(turns)
    while True:
        conversation, at, read, differ = "".join(shown), 0, [], []
        for i, turn in enumerate(turns):
            got = parse(conversation, at)
            at += len(shown[i])
            if got == (*turn, at):
                read.append(got[:2])
            else:
                differ.append(i)
        if not differ:
            return shown, read
        for i in differ:
            if levels[i] == 2:
                raise ValueError("a turn isn't read back as it was")
            levels[i] += 1
            shown[i] = render(*turns[i], levels[i])


def _stretches(keys: list) -> Iterator[tuple[int, int]]:
    """From where to where a batch's rows are of one conversation."""
    low = 0
    for high in range(1, len(keys) + 1):
        if high == len(keys) or keys[high] != keys[low]:
            yield low, high
            low = high


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows by conversation and turn; equal turns by role and text. Null roles and texts are empty; null turns come first."""
    c = conversations
    rows = c.select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """Each row's rendered turn with what the parser reads back from it, see TURNS.

    The rendered conversation is its turns' strings in order. Null text or role is empty; rows of a null conv_id are
    one conversation; repeated rows are turns of their own; an empty table gives no rows; other columns are ignored.
    """
    batches(conversations.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            turns, shown, read = list(zip(frame.column("role").to_pylist(), frame.column("text").to_pylist())), [], []
            for low, high in _stretches(frame.column("conv_id").to_pylist()):
                more = round_trip(turns[low:high])
                shown += more[0]
                read += more[1]
            columns = [*frame.columns, pa.array(shown, pa.string()), pa.array([x[0] for x in read], pa.string()), pa.array([x[1] for x in read], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TURNS.split(", ")])

    return _ordered(conversations).mapInArrow(run, TURNS)


def digests(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """Per conversation, read back from the rendered text: turns, their digest, and length and digest of the text of `trained` turns, see DIGEST."""
    batches(conversations.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.split() for c in DIGEST.split(", ")]
        key, state = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

        def ended() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for frame in frames:
            done, convs = [], frame.column("conv_id").to_pylist()
            turns = list(zip(frame.column("role").to_pylist(), frame.column("text").to_pylist()))
            for low, high in _stretches(convs):
                if state is None or convs[low] != key:
                    if state is not None:
                        done.append(ended())
                    key, state = convs[low], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                shown, read = round_trip(turns[low:high])
                state[0] += len(read)
                state[4] += sum(map(len, shown))
                for role, text in read:
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == trained:
                        state[2] += len(text)
                        state[3].update(text.encode())
            yield batch(done)
        if state is not None:
            yield batch([ended()])

    return _ordered(conversations).mapInArrow(run, DIGEST)
