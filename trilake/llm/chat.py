"""Chat formatting: conversations through a compiled template, and back from the output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trilake.llm.common import small_batches
from trilake.llm.template import compile_template

TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|im_start|>' ~ m.role|line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|control }}{% endgeneration %}"
    "{% else %}{{ m.text|control }}{% endif %}"
    "{{ '<|im_end|>' ~ '\n' }}"
    "{% endfor %}"
)
START, END = "<|im_start|>", "<|im_end|>\n"


def control(text: str) -> str:
    """No control string is left: ``<|`` gets a backslash inside, and one more where there are some."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def uncontrol(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def line(text: str) -> str:
    """As ``control``, on one line."""
    return control(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], uncontrol(text), flags=re.DOTALL)


FILTERS = {"control": control, "line": line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


def rendered(turns: Iterable[dict], template: str = TEMPLATE) -> Iterator[tuple[str, bool]]:
    return compile_template(template, FILTERS)({"messages": turns})


class ReadBack:
    """Takes the pieces of one formatted conversation and keeps what can be told from them.

    It holds one turn at a time, as a conversation may be longer than memory.
    """

    def __init__(self) -> None:
        self.open, self.n_turns, self.loss_chars, self.chars = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.learnt = ""

    def add(self, piece: str, learnt: bool) -> None:
        self.chars += len(piece)
        self.open += piece
        if learnt:
            self.learnt += piece
        at = 0
        while (end := self.open.find(END, at)) >= 0:
            role, _, text = self.open[at + len(START) : end].partition("\n")
            self.turns.update(f"{unline(role)}\n{uncontrol(text)}\n".encode())
            self.n_turns += 1
            at = end + len(END)
            learnt_text = uncontrol(self.learnt)
            self.loss.update(learnt_text.encode())
            self.loss_chars += len(learnt_text)
            self.learnt = ""
        self.open = self.open[at:]

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _in_order(conversations: DataFrame) -> DataFrame:
    """The rows of a conversation together and by turn: sorted for a streaming pass, not gathered."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation's id and a stream of its turns; a stream left unread is skipped."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")))

    source = rows()
    ahead = next(source, None)

    def turns(conv) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            now, ahead = ahead, next(source, None)
            yield {"turn": now[1], "role": now[2], "text": now[3]}

    while ahead is not None:
        conv = ahead[0]
        stream = turns(conv)
        yield conv, stream
        for _ in stream:
            pass


#: Characters of formatted text in one output row.
SEGMENT = 1 << 20
SEGMENTS = "conv_id long, segment long, formatted string, loss array<array<long>>"


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, segment, formatted, loss: the formatted conversations, in segments of about
    ``SEGMENT`` characters, and the spans in each segment that a model is trained on.

    A conversation's rows are taken by turn (ties by role, then text) and streamed through
    the template, so its length is not bound by memory. Null roles and texts are empty; a
    null conv_id is a conversation like others; repeated rows are repeated turns. Other
    columns are ignored; an empty table gives no rows. A template error is raised at once.
    """
    compile_template(template, FILTERS)
    small_batches(conversations.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        ready: list[tuple] = []
        waiting = 0
        for conv, turns in _conversations(batches):
            number, parts, loss, at = 0, [], [], 0
            for piece, learnt in render({"messages": turns}):
                parts.append(piece)
                if learnt and piece:
                    loss.append([at, at + len(piece)])
                at += len(piece)
                if at >= SEGMENT:
                    yield _batch(SEGMENT_TYPES, [*ready, (conv, number, "".join(parts), loss)])
                    ready, waiting, number, parts, loss, at = [], 0, number + 1, [], [], 0
            if parts or not number:
                ready.append((conv, number, "".join(parts), loss))
            waiting += at
            if waiting >= SEGMENT:
                yield _batch(SEGMENT_TYPES, ready)
                ready, waiting = [], 0
        yield _batch(SEGMENT_TYPES, ready)

    return _in_order(conversations).mapInArrow(segments, SEGMENTS)


SEGMENT_TYPES = {"conv_id": pa.int64(), "segment": pa.int64(), "formatted": pa.string(), "loss": pa.list_(pa.list_(pa.int64()))}


def _batch(types: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types.values())], list(types))


DIGEST_TYPES = {
    "conv_id": pa.int64(),
    "n_turns": pa.int64(),
    "turns_sha256": pa.string(),
    "loss_chars": pa.int64(),
    "loss_sha256": pa.string(),
    "formatted_chars": pa.int64(),
}
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What can be told of each conversation from the output of ``format_conversations``
    with the default template alone: turns, digests and characters."""
    rows = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, state = [], None, None
        for batch in batches:
            for conv, segment, text, loss in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if segment == 0:
                    if state is not None:
                        out.append((current, *state.row()))
                    current, state = conv, ReadBack()
                at = 0
                for a, b in loss:
                    state.add(text[at:a], False)
                    state.add(text[a:b], True)
                    at = b
                state.add(text[at:], False)
        if state is not None:
            out.append((current, *state.row()))
        yield _batch(DIGEST_TYPES, out)

    return rows.mapInArrow(digests, DIGESTS)

