"""Chat training examples by prefix-target expansion: each reply behind all that was said before it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template: a turn is <|role|>text</s>. These are the control strings that texts must not hold.
CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]")
START, MIDDLE, END = "<|", "|>", "</s>"
TARGET_ROLE = "assistant"

# The rest of a control string behind its first character, backslashes before it included.
_RESTS = r"<(?=\\*(?:\||/s>|s>))|\|(?=\\*>)|\[(?=\\*/?INST\])"
_PLAIN = re.compile(_RESTS)
_ESCAPED = re.compile(_RESTS.replace("(?=", r"\\(?="))
_TURN = re.compile(r"<\|(.*?)\|>(.*?)</s>", re.S)


def escape(text: str) -> str:
    """Put a backslash behind the first character of every control string, one more where there are some."""
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The text that :func:`escape` was given."""
    return _ESCAPED.sub(lambda m: m[0][:1], text)


def turn_text(role: str, text: str) -> str:
    return f"{START}{escape(role)}{MIDDLE}{escape(text)}{END}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def expanded(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per assistant turn of each conversation, as a training example, and one for what follows the last.

    Columns: conv_id; example (from 0); text, every turn before the reply as its context, then the reply;
    context_chars, how much of it the example before has too; loss_start and loss_end, the trainable
    characters as places in the text, the reply's text and nothing else; target, whether there is a reply.
    The last row of a conversation whose last turns have no reply has no target and no trainable characters.

    Turns are ordered by ``turn``, nulls first, equal ones by role and text. A null text or role is
    empty. Rows of a null conv_id are a conversation of their own; repeated rows are turns like any other.
    The turns of a conversation are sorted by a shuffle and read one by one, so no task holds more than
    a few examples; the rows of one conversation are read by one task, as their order is its meaning.
    Contexts are repeated once for each reply behind them: what comes out grows with the square of a
    conversation's length, and in proportion to the number of conversations.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for key, example, whole, before, low, high in _examples(_turns(batches)):
            out.append((key, example, whole, before, low, high, low is not None))
            held += len(whole)
            if held > 4_000_000:
                yield _batch(out)
                out, held = [], 0
        yield _batch(out)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(expand, "conv_id long, example long, text string, context_chars long, loss_start long, loss_end long, target boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "example", "text", "context_chars", "loss_start", "loss_end", "target"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return _columns(rows, names, kinds)


def _columns(rows: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    return _rows(batches, ("conv_id", "role", "text"), 1_000)


def _examples(turns: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple]:
    """(conv_id, example, text, context_chars, loss_start, loss_end) of turns in order, contexts written out."""
    now: tuple = ()
    text = ""
    parts: list[str] = []
    example = 0
    for key, role, said in turns:
        if (key,) != now:
            if parts:
                yield now[0], example, text + "".join(parts), len(text), None, None
            now, text, parts, example = (key,), "", [], 0
        parts.append(turn_text(role, said))
        if role == TARGET_ROLE:
            before, text, parts = len(text), text + "".join(parts), []
            end = len(text) - len(END)
            yield key, example, text, before, end - len(escape(said)), end
            example += 1
    if parts:
        yield now[0], example, text + "".join(parts), len(text), None, None


def full_texts(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) of every reply, the text with its whole context."""
    return examples.where("target").select("conv_id", "example", "text", "loss_start", "loss_end")


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, worked out from their texts and spans alone.

    conv_id; n_turns; turns_sha256, over role, newline, text, newline of each turn of the last example, which
    holds all of them; loss_chars and loss_sha256 of the trainable text of all examples, unescaped;
    formatted_chars, the length of the last example; expanded_chars, the length of all examples with a
    reply; n_examples, their number. Every text is read where it is; only digests and replies move.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for key, example, text, low, high in _rows(batches, ("conv_id", "example", "text", "loss_start", "loss_end"), 100):
            turns = read_turns(text)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
            reply = None if low is None else unescape(text[low:high])
            out.append((key, example, len(turns), digest, len(text), reply))
            held += 200 + len(reply or "")
            if held > 4_000_000:
                yield _columns(out, names, kinds)
                out, held = [], 0
        yield _columns(out, names, kinds)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        state: list = []
        for key, n_turns, digest, chars, reply in _rows(batches, ("conv_id", "n_turns", "turns_sha256", "chars", "reply"), 1_000):
            if not state or state[0] != (key,):
                if state:
                    out.append(_row(state))
                if len(out) > 5_000:
                    yield _digests(out)
                    out = []
                state = [(key,), 0, "", 0, hashlib.sha256(), 0, 0, 0]
            state[1], state[2], state[5] = n_turns, digest, chars
            if reply is not None:
                state[3] += len(reply)
                state[4].update(reply.encode("utf-8", "surrogatepass"))
                state[6] += chars
                state[7] += 1
        if state:
            out.append(_row(state))
        yield _digests(out)

    names = ["conv_id", "example", "n_turns", "turns_sha256", "chars", "reply"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    each = examples.select("conv_id", "example", "text", "loss_start", "loss_end").mapInArrow(
        read, "conv_id long, example long, n_turns long, turns_sha256 string, chars long, reply string"
    )
    ordered = each.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.mapInArrow(
        total,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_chars long, n_examples long",
    )


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], at_once: int) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for low in range(0, batch.num_rows, at_once):
            yield from zip(*(c.slice(low, at_once).to_pylist() for c in columns), strict=True)


def _row(state: list) -> list:
    return [state[0][0], state[1], state[2], state[3], state[4].hexdigest(), *state[5:]]


def _digests(rows: list[list]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_chars", "n_examples"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return _columns(rows, names, kinds)
