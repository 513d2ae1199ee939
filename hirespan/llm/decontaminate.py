"""Benchmark passages in documents, found by latent semantic retrieval and confirmed word by word.

1. Every document's words become 16-bit codes, written once; how many documents hold each code, over all
   documents, gives the weights (tf-idf).
2. The benchmark's codes span the space. One pass over the passages of all documents multiplies their second
   moments with a random matrix, and the sums give the leading directions (randomised SVD, one pass, by
   Nystrom's formula).
3. Windows of documents are projected and held against all windows of the benchmark by cosine. How long a
   window is and how far the next one begins follows from an item's length (``WINDOWS``), such that a copy
   of an item always holds a whole window. A window with too little of its weight on the benchmark's words is
   passed over. All documents are searched.
4. Around each candidate the longest common subsequence with the item is taken on codes, then, for
   documents that remain, on words. A document holds an item if it covers ``COVER`` of the item's words
   and ``ANSWER_COVER`` of its answer: the given answer, or else the last quarter of its words.

So a verbatim copy of an item of any length is found. Of altered copies that the rule of step 4 accepts, some are not
near enough in any window; tests hold the share found against brute force. Items go in blocks of ``ITEMS``, and
windows in parts whose products take some 32 MB, so what a task is sent and holds is bounded whatever the
benchmark's size.

Defined results: null and empty texts hold nothing, null and empty items are held by nothing; repeated
rows are judged alike; of equally covered items the smallest id is given; empty tables give no finding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirespan.llm import tokens, words
from hirespan.llm.tables import frugal, small_batches, written

# Least words of an item, and length, distance and least cosine of the windows it is looked for with: a run of
# length + distance - 1 words holds a window. In a short item an altered word weighs more.
WINDOWS = [(24, 7, 8, 0.75), (15, 5, 5, 0.75), (7, 3, 3, 0.6), (4, 2, 2, 0.6), (1, 1, 1, 0.6)]
PASSAGE = 10  # words of a passage, for the directions
AT_ONCE = 8 << 20  # cosines worked out at once
COVER, ANSWER_COVER = 0.75, 0.5
DIRECTIONS, SAMPLED = 128, 160
COUNTED, BLOCK = 5792, 32  # most codes whose pairs a task counts (64 MB); codes whose sums go together
CODES = 1 << 16
ITEMS = 1000
FOUND = "doc_id long, item_id long, covered double"


def places(a: list[int]) -> dict[int, int]:
    """Where each word stands in ``a`` (as bits)."""
    at: dict[int, int] = {}
    for k, word in enumerate(a):
        at[word] = at.get(word, 0) | 1 << k
    return at


def common(a: list[int], b: list[int], at: dict[int, int] | None = None) -> tuple[int, int]:
    """Length of the longest common subsequence of ``a`` and ``b``, and which of ``a`` it takes (as bits).

    Bit-parallel: a row of the usual table is one integer. ``at``, if known, are the ``places`` of ``a``.
    """
    at = places(a) if at is None else at
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & at.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    taken = full & ~row
    return taken.bit_count(), taken


@dataclass(frozen=True)
class Item:
    item_id: int
    words: list[int]  # hashes
    answer: list[int]
    known: dict = field(default_factory=dict, compare=False, repr=False)

    def _of(self, of: int) -> list[tuple[list[int], dict[int, int]]]:
        """Words and answer modulo ``of``, with their places."""
        if of not in self.known:
            self.known[of] = [(x, places(x)) for x in ([w % of for w in y] for y in (self.words, self.answer))]
        return self.known[of]

    def covered(self, segment: list[int], of: int = 1 << 64) -> float:
        """Share of the item in a run of words, 0 if too little of it or of its answer is there.

        Words of the item that the run lacks are in no common subsequence, so they are counted first.
        """
        (mine, at), (answer, answer_at) = self._of(of)
        if sum(map(set(segment).__contains__, mine)) / len(mine) < COVER:
            return 0.0
        share = common(mine, segment, at)[0] / len(mine)
        if share < COVER or answer and common(answer, segment, answer_at)[0] < ANSWER_COVER * len(answer):
            return 0.0
        return share

    def around(self, start: int) -> slice:
        """Where a document's words may hold the item if its first word is about at ``start``."""
        room = max(8, len(self.words) // 4)
        return slice(max(0, start - room), max(0, start + len(self.words) + room))


def items_of(rows: list, answers: list | None = None) -> list[Item]:
    hashes, at = words.hashed(pa.array([r["text"] for r in rows], pa.string()))
    out = []
    for k, r in enumerate(rows):
        own = hashes[at[k] : at[k + 1]].tolist()
        if own and r["item_id"] is not None:
            given = words.hashed(pa.array([answers[k]], pa.string()))[0].tolist() if answers else []
            out.append(Item(int(r["item_id"]), own, given or own[-(len(own) // 4) :]))
    return out


def coded(docs: DataFrame) -> DataFrame:
    """(doc_id, codes): each document's words as 16-bit codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.without_encoder()
        for batch in batches:
            for some in tokens.parts_of(batch, "text", tokens.SLICE):
                hashes, at = words.hashed(some.column("text"))
                codes = (hashes % np.uint64(CODES)).astype("<u2")
                cut = [codes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id"), "codes": pa.array(cut, pa.binary())})

    small_batches(docs.sparkSession)
    return docs.mapInArrow(frugal(run), "doc_id long, codes binary")


def weights(codes: DataFrame) -> np.ndarray:
    """The weight of each code by how many documents hold it.

    At most ``CODES`` sums come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CODES + 1, np.int64)
        for batch in batches:
            for raw in batch.column("codes").to_pylist():
                held[np.unique(np.frombuffer(raw, "<u2"))] += 1
            held[CODES] += batch.num_rows
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"code": there.astype(np.int32), "n": held[there]})

    counted = codes.select("codes").mapInArrow(frugal(run), "code int, n long")
    rows = counted.groupBy("code").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(CODES + 1)
    for r in rows:
        held[r["code"]] = r["n"]
    return (np.log((1 + held[CODES]) / (1 + held[:CODES])) + 0.1).astype(np.float32)


def _batched(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch, and where its documents start."""
    raw = batch.column("codes").to_pylist()
    return np.frombuffer(b"".join(raw), "<u2"), np.append(0, np.cumsum([len(x) // 2 for x in raw]))


def windows(at: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each window; the last one of a document ends with it."""
    size = np.diff(at)
    count = np.where(size > 0, np.maximum(0, -(-(size - length) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(size)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = at[:-1][doc] + np.minimum(within * stride, np.maximum(0, size[doc] - length))
    return doc, start, np.minimum(start + length, at[1:][doc])


def projected(latent: np.ndarray, every: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """The directions of windows of ``every``, rows of ``latent``, each of length one."""
    sums = sum(latent[every[np.minimum(start + k, len(every) - 1)]] * (start + k < end)[:, None] for k in range(length))
    return sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-9)


@dataclass(frozen=True)
class Queries:
    """The windows of all items that are looked for with windows of one length."""

    length: int
    stride: int
    cosine: float
    owner: np.ndarray  # the item of a window
    offset: np.ndarray  # where in the item it starts
    vectors: np.ndarray

    def near(self, latent: np.ndarray, place: np.ndarray, squares: tuple, every: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (document, item, where the item would start, by steps of 4), some at a time, none twice in a part."""
        doc, first, last = windows(bounds, self.length, self.stride)
        inside, whole = (np.append(0.0, np.cumsum(s[every], dtype=np.float64)) for s in squares)
        share = (inside[last] - inside[first]) >= self.cosine**2 * (whole[last] - whole[first])
        doc, first, last = doc[share], first[share], last[share]
        step = max(16, AT_ONCE // len(self.vectors))
        rows_of = place[every]
        for at in range(0, len(doc), step):
            some = slice(at, at + step)
            cosines = projected(latent, rows_of, first[some], last[some], self.length) @ self.vectors.T
            close = np.flatnonzero(cosines.max(1) >= self.cosine)  # few windows are close to any
            w, q = np.nonzero(cosines[close] >= self.cosine)
            w = close[w]
            begin = first[some][w] - bounds[doc[some][w]] - self.offset[q]
            # A row as one number: the start, from the lowest one on, then item, then document.
            step4 = begin // 4 - (lowest := begin.min(initial=0) // 4)
            wide, many = int(step4.max(initial=0)) + 1, int(self.owner.max()) + 1
            rows = np.unique((doc[some][w] * many + self.owner[q]) * wide + step4)
            yield np.column_stack([rows // wide // many, rows // wide % many, rows % wide + lowest])


def passages(every: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """A row for each passage of ``PASSAGE`` words; what a document's last one lacks is ``none``."""
    size = np.diff(at)
    room = -(-size // PASSAGE) * PASSAGE
    out = np.full(int(room.sum()), none, np.int64)
    out[np.arange(len(every)) + np.repeat(np.cumsum(room) - room - at[:-1], size)] = every
    return out.reshape(-1, PASSAGE)


def pairs_of(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The pairs of codes in passages, each as its place in a lower triangle of ``size`` rows, by distance."""
    rows = np.sort(rows, axis=1)  # what is no code comes last
    above = rows * (rows + 1) // 2
    for lag in range(1, PASSAGE):
        high = rows[:, lag:] < size
        yield above[:, lag:][high] + rows[:, : PASSAGE - lag][high]


def moments(codes: DataFrame, weight: np.ndarray, place: np.ndarray, random: np.ndarray) -> np.ndarray:
    """(A' A) R for the passages A of all documents, as weights of the benchmark's codes, and R = ``random``.

    With few codes a task counts the pairs of codes that share a passage, each pair in one place, which are then
    multiplied once; with more than ``COUNTED`` it multiplies passage by passage, words of no code left out. Tasks
    give sums by blocks of codes, which Spark adds up.
    """
    size, rank = random.shape
    own = weight[place >= 0].astype(np.float64)
    scaled = random * own[:, None]

    def products(rows: np.ndarray, total: np.ndarray) -> None:
        flat = rows.ravel()
        at = np.flatnonzero(flat < size)
        if not len(at):
            return
        passage = at // PASSAGE
        firsts = np.flatnonzero(np.diff(passage, prepend=-1))
        seen = np.add.reduceat(scaled[flat[at]], firsts, 0)
        which = np.cumsum(np.diff(passage, prepend=-1) > 0) - 1
        order = np.argsort(flat[at], kind="stable")
        there, starts = np.unique(flat[at][order], return_index=True)
        total[there] += np.add.reduceat(seen[which[order]], starts, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = size <= COUNTED
        pairs = np.zeros(size * (size + 1) // 2 if few else 0, np.int32)
        total, alone = np.zeros((size, rank)), np.zeros(size + 1, np.int64)
        for batch in batches:
            every, at = _batched(batch)
            whole = passages(np.where(place[every] >= 0, place[every], size), at, size)
            for first in range(0, len(whole), 1 << 13):
                rows = whole[first : first + (1 << 13)]
                if few:
                    for some in pairs_of(rows, size):
                        np.add.at(pairs, some, np.int32(1))
                    alone += np.bincount(rows.ravel(), minlength=size + 1)
                else:
                    products(rows, total)
        if few:
            total += alone[:size, None] * scaled
            for k in range(0, size, 128):  # rows of the triangle: a pair counts for its first and its second code
                end = min(k + 128, size)
                part = np.zeros((end - k, end))
                for row in range(k, end):
                    part[row - k, : row + 1] = pairs[row * (row + 1) // 2 : (row + 1) * (row + 2) // 2]
                total[k:end] += part @ scaled[:end]
                total[:end] += part.T @ scaled[k:end]
        total *= own[:, None]
        starts = range(0, size, BLOCK)
        parts = [np.ascontiguousarray(total[k : min(k + BLOCK, size)], "<f8").tobytes() for k in starts]
        yield pa.RecordBatch.from_pydict({"block": pa.array(starts, pa.int32()), "part": pa.array(parts, pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x.as_py(), "<f8") for x in group.column("part"))
        return pa.table({"block": group.column("block")[:1], "part": pa.array([whole.tobytes()], pa.binary())})

    parts = codes.select("codes").mapInArrow(frugal(run), "block int, part binary")
    sums = parts.groupBy("block").applyInArrow(added, "block int, part binary")
    y = np.zeros((size, rank))
    for r in sums.toLocalIterator():
        y[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["part"], "<f8").reshape(-1, rank)
    return y


def directions(codes: DataFrame, weight: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A row for each of the benchmark's codes: its place in the leading directions of all passages.

    ``place`` numbers those codes in order, -1 for others.
    """
    size = int(place.max()) + 1
    rank = min(SAMPLED, size)
    random = np.random.default_rng(7).standard_normal((size, rank)).astype(np.float32)
    y = moments(codes, weight, place, random)
    # Nystrom: with S = R' Y, the leading directions of A'A are those of Y S^-1/2.
    shift = 1e-7 * np.linalg.norm(y) + 1e-12
    core = random.T @ (y + shift * random)
    value, vector = np.linalg.eigh((core + core.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-9 * max(value.max(), 1e-9)))
    left, _, _ = np.linalg.svd((y + shift * random) @ root, full_matrices=False)
    return left[:, :DIRECTIONS].astype(np.float32)


def search(codes: DataFrame, items: list[Item], weight: np.ndarray) -> DataFrame:
    """(doc_id, item_id): documents that on codes cover an item near a window that is close to one of its own."""
    flat = np.array([w % CODES for item in items for w in item.words], np.int64)
    at = np.append(0, np.cumsum([len(item.words) for item in items]))
    place = np.full(CODES, -1, np.int64)
    place[np.unique(flat)] = np.arange(len(np.unique(flat)))
    basis = directions(codes, weight, place)
    # Every task gets it: a row for each of the benchmark's codes, and one of zeros for all others (place -1).
    latent = np.zeros((len(basis) + 1, basis.shape[1]), np.float32)
    latent[:-1] = basis * weight[place >= 0, None]
    place = place.astype(np.int32)
    queries = []
    lengths = np.diff(at)
    for k, (least, length, stride, cosine) in enumerate(WINDOWS):
        owner, start, end = windows(at, length, 1)
        most = WINDOWS[k - 1][0] if k else np.inf
        of_class = (lengths[owner] >= least) & (lengths[owner] < most)
        if of_class.any():
            owner, start, end = owner[of_class], start[of_class], end[of_class]
            vectors = projected(latent, place[flat], start, end, length)
            queries.append(Queries(length, stride, cosine, owner, start - at[owner], vectors))
    # What a window may weigh outside the benchmark's words if it is to come close to a window in them.
    squares = np.where(place >= 0, weight, 0) ** 2, weight**2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            every, bounds = _batched(batch)
            found: set[tuple] = set()
            for kind in queries:
                for rows in kind.near(latent, place, squares, every, bounds):
                    for d, item, begin in rows.tolist():
                        if (d, item) not in found:
                            own = every[bounds[d] : bounds[d + 1]][items[item].around(4 * begin)].tolist()
                            if items[item].covered(own, CODES):
                                found.add((d, item))
            rows = sorted((d, i) for d, i in found if ids[d] is not None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[d] for d, _ in rows], pa.int64()),
                    "item_id": pa.array([items[i].item_id for _, i in rows], pa.int64()),
                }
            )

    return codes.mapInArrow(frugal(run), "doc_id long, item_id long")


def confirmed(candidates: DataFrame, docs: DataFrame, items: list[Item]) -> DataFrame:
    """Candidates that hold on words: every place of the document is tried, so none is missed."""
    by_id: dict[int, list[Item]] = {}
    for item in items:
        by_id.setdefault(item.item_id, []).append(item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, at = words.hashed(batch.column("text"))
            rows = []
            for k, (doc, wanted) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                own = hashes[at[k] : at[k + 1]].tolist()
                for item in (i for w in wanted for i in by_id[w]):
                    step = max(1, len(item.words) // 8)
                    rare = set(item.words)
                    hits = np.cumsum([0, *(w in rare for w in own)])
                    best = 0.0
                    for start in range(0, max(1, len(own)), step):
                        span = item.around(start)
                        if hits[min(span.stop, len(own))] - hits[min(span.start, len(own))] >= COVER * len(item.words):
                            best = max(best, item.covered(own[span]))
                    if best:
                        rows.append((doc, item.item_id, best))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "covered"])

    wanted = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("wanted"))
    return docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(frugal(run), FOUND)


def findings(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, covered): every document that holds an item, with each such item.

    ``benchmark`` has item_id and text, and may have an ``answer``.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    columns = ["item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])]
    asked = benchmark.select(*columns).where("item_id is not null").distinct()
    blocks = -(-asked.count() // ITEMS)
    codes = written(coded(docs), "codes")
    weight = weights(codes)
    out = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(*columns), F.lit(blocks)) == block).collect()
        items = items_of(rows, [r["answer"] for r in rows] if "answer" in columns else None)
        if items:
            candidates = written(search(codes, items, weight), "candidates")
            out = out.unionByName(written(confirmed(candidates, docs, items), "findings"))
    return out


def best_of(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``item_id`` and ``covered`` of the best-covered item (null if none) and ``contaminated``."""
    best = found.groupBy("doc_id").agg(F.min(F.struct((-F.col("covered")).alias("c"), "item_id")).alias("_best"))
    best = best.select(
        F.col("doc_id").alias("_doc"), F.col("_best.item_id").alias("item_id"), (-F.col("_best.c")).alias("covered")
    )
    docs = docs.drop("item_id", "covered", "contaminated")
    joined = docs.join(best, docs[doc_id].cast("long") == best["_doc"], "left").drop("_doc")
    return joined.withColumn("contaminated", F.col("item_id").isNotNull())
