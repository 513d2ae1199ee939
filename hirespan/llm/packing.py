"""Packing documents into windows of a fixed number of tokens, by non-negative least squares.

A document's ids are cut into whole windows and a tail. Tails are packed block by block, a block being
the documents of one task until they hold ``BLOCK`` tokens: combinations of two or three tail lengths
that fill a window exactly are enumerated from the block's histogram of lengths, non-negative least
squares says how often to use each, the counts are rounded to what is there, and the tails left over are
laid end to end, longest first, and cut at each window's end. The last stretch is cut at powers of two,
which need no padding. So no id is padded, and only left-over tails are ever cut.

Blocks are independent: nothing is shuffled or gathered, and a task that is run again on the same rows
gives the same sequences. Sequence ids hold the task's number in their upper bits.

Defined results: a null or empty text is its end id alone; repeated rows are packed as rows of their
own; an empty table gives no pieces; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hirespan.llm import tokens
from hirespan.llm.tables import frugal, small_batches

WINDOW = 1024
BLOCK = 1_000_000
TRIPLES = 8  # combinations of three looked at for each longest member
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def combinations(counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Pairs and triples of lengths with ``counts`` that fill the window, longest first, 0 for no third."""
    there = np.flatnonzero(counts)
    there = there[there > 0]
    pairs = [(a, window - a, 0) for a in there if 2 * a >= window and window - a > 0 and counts[window - a]]
    triples = []
    for a in there:
        b = there[(there <= min(a, window - a - 1)) & (2 * there >= window - a)]
        b = b[counts[window - a - b] > 0]
        best = np.argsort(-np.minimum(counts[b], counts[window - a - b]), kind="stable")[:TRIPLES]
        triples += [(a, b[k], window - a - b[k]) for k in best]
    return np.array(pairs + triples, np.int64).reshape(-1, 3)


def least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 minimising |A x - counts|, where column p of A counts the lengths in combination p.

    Projected gradient steps with momentum; A is never built, as each column has two or three entries.
    """
    size, used = len(counts), combos > 0

    def packed(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos[used], np.repeat(x[:, None], 3, 1)[used], size)

    # The largest eigenvalue of A'A is at most the largest sum of a row of it.
    step = 1.0 / max(1.0, float((np.where(used, packed(np.ones(len(combos)))[combos], 0)).sum(1).max()))
    x = y = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(rounds):
        rest = counts - packed(y)
        moved = np.maximum(0.0, y + step * np.where(used, rest[combos], 0.0).sum(1))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = moved + (momentum - 1) / following * (moved - x)
        x, momentum = moved, following
    return x


def packed_tails(tails: np.ndarray, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (index into ``tails``, start in the tail, length); ``tails`` are lengths below the window."""
    stacks: dict[int, list[int]] = {}
    for k in range(len(tails) - 1, -1, -1):
        if tails[k]:
            stacks.setdefault(int(tails[k]), []).append(k)
    counts = np.bincount(tails, minlength=window + 1)
    counts[0] = 0
    combos = combinations(counts, window)
    if len(combos):
        x = least_squares(combos, counts)
        for p in np.argsort(-x, kind="stable"):
            lengths = [int(v) for v in combos[p] if v]
            for _ in range(round(x[p])):
                if any(len(stacks.get(v, ())) < lengths.count(v) for v in lengths):
                    break
                yield [(stacks[v].pop(), 0, v) for v in lengths]
    room, sequence = window, []
    for length in sorted(stacks, reverse=True):
        for k in reversed(stacks[length]):
            start = 0
            while start < length:
                take = min(room, length - start)
                sequence.append((k, start, take))
                start, room = start + take, room - take
                if not room:
                    yield sequence
                    room, sequence = window, []
    yield from _at_powers(sequence)


def _at_powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces dealt into sequences whose lengths are powers of two, largest first."""
    left = sum(p[2] for p in pieces)
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            k, start, length = pieces.pop()
            take = min(room, length)
            sequence.append((k, start, take))
            room -= take
            if take < length:
                pieces.append((k, start + take, length - take))
        yield sequence


def _block(doc_ids: list, ids: np.ndarray, bounds: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of one block, and the next free sequence number."""
    sizes = np.diff(bounds)
    full, tails = sizes // WINDOW, sizes % WINDOW
    owner = np.repeat(np.arange(len(sizes)), full)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    rows = [(int(k), int(j) * WINDOW, WINDOW, first + n, 0) for n, (k, j) in enumerate(zip(owner, within, strict=True))]
    number = first + len(rows)
    for sequence in packed_tails(tails):
        offset = 0
        for k, start, length in sequence:
            rows.append((k, int(full[k]) * WINDOW + start, length, number, offset))
            offset += length
        number += 1
    raw = ids.tobytes()  # its parts are copied: Arrow never lets go of a memoryview it took values from
    at = bounds.tolist()
    columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
    cut = [raw[4 * (at[k] + s) : 4 * (at[k] + s + n)] for k, s, n in zip(*columns[:3], strict=True)]
    out = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([doc_ids[k] for k in columns[0]], pa.int64()),
            "start": pa.array(columns[1], pa.int64()),
            "length": pa.array(columns[2], pa.int64()),
            "ids": pa.array(cut, pa.binary()),
            "doc_tokens": pa.array([int(sizes[k]) for k in columns[0]], pa.int64()),
            "sequence_id": pa.array(columns[3], pa.int64()),
            "offset": pa.array(columns[4], pa.int64()),
        }
    )
    return out, number


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents: ids (little-endian unsigned 32-bit), their place in document and sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        number = TaskContext.get().partitionId() << 40
        doc_ids: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for some in tokens.parts_of(batch, "text", tokens.SLICE):
                ids, starts = tokens.with_end(*encode(some.column("text")))
                doc_ids += some.column("doc_id").to_pylist()
                parts.append(ids)
                sizes.append(np.diff(starts))
                held += len(ids)
                if held >= BLOCK:
                    out, number = _block(doc_ids, np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes))), number)
                    yield out
                    doc_ids, parts, sizes, held = [], [], [], 0
        if doc_ids:
            yield _block(doc_ids, np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes))), number)[0]

    small_batches(docs.sparkSession)
    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text").mapInArrow(frugal(run), SCHEMA)
