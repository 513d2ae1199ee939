"""Chat formatting: turns are laid out in one preallocated Arrow buffer by their lengths.

A turn is ``### Role: text </turn>`` and a line break; its text is escaped so that no control string is
left in it: a backslash before each backslash and before each control string. Per batch the lengths of
all segments are computed, their running sums give the offsets, and headers, texts and trailers are
scattered into one byte buffer by index arithmetic. The mask counts the characters that are learnt: an
assistant's text. The output holds a row per turn with the formatted bytes and the place of the text in
them, in code points; a conversation is its rows in order, so one of any length is never held as a whole.

``read_back`` reverses it from the formatted bytes alone.

Defined results: a null text is empty; a null role is an empty role; turns of equal number are ordered
by role, then text, nulls first; repeated rows are turns of their own; an empty table gives an empty
one; columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirespan.llm.tables import small_batches

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
LEARNT = "assistant"
# What is escaped: the escape sign, and what could be taken for a turn's marks; in roles the colon behind them too.
CONTROL = r"(\\|###|</turn>)"
ROLE_CONTROL = r"(\\|###|</turn>|:)"
SCHEMA = "conv_id long, turn long, formatted binary, chars long, learnt_start long, learnt_chars long"
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.S)


def scatter(columns: list[pa.Array]) -> pa.Array:
    """Row by row, the columns' strings end to end: one buffer, filled column by column."""
    parts = []
    for column in columns:
        _, offsets, data = column.cast(pa.large_binary()).buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        parts.append((at, np.frombuffer(data or b"", np.uint8)))
    sizes = np.stack([np.diff(at) for at, _ in parts], 1)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    buffer = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for k, (at, data) in enumerate(parts):
        size = sizes[:, k]
        # Target of each byte: its source place moved by how far its segment moves.
        moved = np.repeat(ends[:, k] - size - at[:-1], size)
        source = np.arange(size.sum()) + np.repeat(at[:-1] - (np.cumsum(size) - size), size)
        buffer[source + moved] = data[source]
    offsets = np.append(0, ends[:, -1]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])


def formatted(turns: DataFrame) -> DataFrame:
    """A row per turn of (conv_id, turn, role, text), formatted. No order is needed and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            role, text = (pc.fill_null(batch.column(c).cast(pa.large_string()), "") for c in ("role", "text"))
            learnt = pc.equal(role, LEARNT).to_numpy(zero_copy_only=False)
            role = pc.replace_substring_regex(role, ROLE_CONTROL, r"\\\1")
            text = pc.replace_substring_regex(text, CONTROL, r"\\\1")
            fixed = [pa.repeat(pa.scalar(s, pa.large_string()), batch.num_rows) for s in (OPEN, AFTER_ROLE, CLOSE)]
            out = scatter([fixed[0], role, fixed[1], text, fixed[2]])
            before = pc.utf8_length(role).to_numpy() + len(OPEN) + len(AFTER_ROLE)
            inside = pc.utf8_length(text).to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch.column("conv_id"),
                    "turn": batch.column("turn"),
                    "formatted": out.cast(pa.binary()),
                    "chars": pa.array(before + inside + len(CLOSE), pa.int64()),
                    "learnt_start": pa.array(before, pa.int64()),
                    "learnt_chars": pa.array(np.where(learnt, inside, 0), pa.int64()),
                }
            )

    small_batches(turns.sparkSession)
    return turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").mapInArrow(run, SCHEMA)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parsed(raw: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, text = _TURN.fullmatch(raw).groups()
    return unescaped(role), unescaped(text)


def read_back(rows: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns in order: counts and digests of turns and of what is learnt.

    A digest over a conversation is a sequence by nature: its turns are sorted into one task and pass
    through it batch by batch, with only the running digests held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def out() -> pa.RecordBatch:
            turns, turns_sha, learnt, learnt_sha, chars = state
            return pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([current], pa.int64()),
                    "n_turns": pa.array([turns], pa.int64()),
                    "turns_sha256": [turns_sha.hexdigest()],
                    "loss_chars": pa.array([learnt], pa.int64()),
                    "loss_sha256": [learnt_sha.hexdigest()],
                    "formatted_chars": pa.array([chars], pa.int64()),
                }
            )

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "learnt_start", "learnt_chars")]
            for conv, raw, start, size in zip(*columns, strict=True):
                if state is None or conv != current:
                    if state:
                        done.append(out())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = raw.decode()
                role, text = parsed(raw)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                learnt = unescaped(raw[start : start + size])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(raw)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if state:
            yield out()

    text = F.col("formatted").cast("string")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", text)
    return ordered.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
