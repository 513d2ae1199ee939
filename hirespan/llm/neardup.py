"""Near duplicates by minwise signatures and a Hamming join over several indexes.

A text's signature has ``CHUNKS`` chunks of ``SYMBOLS`` 16-bit symbols, each from one minwise hash of its
shingles. The signature distance up to which every pair is sure to be found is ``2 * CHUNKS - 1`` = 31 of 112
symbols: some chunk then differs in one symbol at most, so with each chunk entered once for each symbol left
out the pair shares an entry. Pairs found beyond that distance count as well, up to ``FARTHEST``, a filter
that spares reading sets. Links are confirmed on full sets; of pairs at the similarity 0.8 itself, one in a
million shares no entry.

Texts with equal sets form a class by a digest of the set, summed up before any shuffle; all else works
on classes. In each of ``ROUNDS`` rounds a class is held against one other: of the first classes of its entries
that are still in other components, the one it shares most entries with. So a group of near copies becomes
one component with a pair or two a class. The classes of entries that then still have several components are held against each other
entry by entry, in blocks bounded by bytes and by members, so no link between components is lost.

Defined results: a text without words has an empty set, is its own component and linked with nothing;
one with fewer words than a shingle has all of them as its one shingle. Repeated rows belong to one
class and each give a row; rows of one id with different texts are in classes of their own, each with a row.
A null id gives a row that is never kept, and a text found under null ids only links nothing. An empty
table gives an empty one. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirespan.llm import tokens, words
from hirespan.llm.components import components, merged
from hirespan.llm.tables import frugal, small_batches, written

CHUNKS, SYMBOLS = 16, 7
WIDTH = 2
SHARE = 80  # per cent of the union that the intersection must reach
# At the least similarity linked, 22 of 112 symbols differ on average; more than 46 do in one pair of ten million.
FARTHEST = 46
ROUNDS = 2
BLOCK, MEMBERS = 8 << 20, 1000  # bytes and sets held against each other at once
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PLACES = np.arange(1, CHUNKS * SYMBOLS + 1, dtype=np.uint64)
_A = words.mixed(_PLACES).astype(np.uint32) | np.uint32(1)
_B = words.mixed(_PLACES + np.uint64(1000)).astype(np.uint32)


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of the least value under each of the hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, (x[at : at + 512, None] * _A + _B).min(0))
    return ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype("<u2").tobytes()


def entries(signatures: np.ndarray) -> np.ndarray:
    """Keys of shape (rows, chunks, symbol left out) from signatures of shape (rows, chunks * symbols)."""
    terms = words.mixed(signatures.astype(np.uint64) + (_PLACES << np.uint64(20))).reshape(-1, CHUNKS, SYMBOLS)
    left_out = words.mixed(_PLACES << np.uint64(40)).reshape(CHUNKS, SYMBOLS)
    return words.mixed(terms.sum(2, dtype=np.uint64)[:, :, None] - terms + left_out)


def _per_text(
    docs: DataFrame, schema: str, width: int, row: Callable[[np.ndarray], tuple], name: str = "doc_id"
) -> DataFrame:
    """One row per document, its id under ``name``, from its set of shingles."""
    names = [part.split()[0] for part in schema.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.without_encoder()
        for batch in batches:
            for some in tokens.parts_of(batch, "text"):
                rows = [row(s) for s in words.shingle_sets(some.column("text"), width)]
                columns = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                yield pa.RecordBatch.from_pydict({name: some.column("doc_id"), **columns})

    small_batches(docs.sparkSession)
    return docs.mapInArrow(frugal(run), schema)


def described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest, sig): size, digest and signature of each set."""

    def row(s: np.ndarray) -> tuple:
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s)

    return _per_text(docs, "doc_id long, n long, digest binary, sig binary", width, row)


def entered(classes: DataFrame) -> DataFrame:
    """(key, rep): a class's entries in all indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(batch.num_rows, -1)
                keys = entries(sigs).reshape(batch.num_rows, -1)
                reps = np.repeat(batch.column("rep").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_pydict({"key": keys.ravel().view(np.int64), "rep": reps})

    return classes.select("rep", "sig").mapInArrow(frugal(run), "key long, rep long")


def _both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the columns of both members, as x_a and x_b."""
    for end in "ab":
        pairs = pairs.join(table.select(F.col("rep").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def close(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Pairs whose sizes allow a link and whose signatures do not rule it out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2") for c in ("sig_a", "sig_b"))
                differ = (a != b).reshape(batch.num_rows, -1).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(differ <= FARTHEST))

    both = _both(pairs, classes, ["n", "sig"])
    both = both.where(100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(frugal(run), "a long, b long")


def sets_of(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(rep, shingles): the full sets of ``classes`` (rep, low, digest), worked out from one document of each.

    Rows of one id may have different texts; the digest says which of them is meant.
    """
    texts = docs.join(classes.select(F.col("low").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def row(s: np.ndarray) -> tuple:
        return xxhash.xxh3_128_digest(s.tobytes()), s.tobytes()

    sets = _per_text(texts, "low long, digest binary, shingles binary", width, row, "low")
    return classes.join(sets, ["low", "digest"]).select("rep", "shingles").dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shingles_a", "shingles_b")]
            linked = []
            for a, b in zip(*columns, strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= share * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = _both(pairs, sets, ["shingles"])
    return both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(frugal(run), "a long, b long")


def _crossing(sets: list[np.ndarray], sigs: np.ndarray, places: np.ndarray, split: int, share: int) -> list[tuple[int, int]]:
    """Links found between members of different places, row by row; a link makes two places one from then on.

    The first ``split`` members are held against the others; with no split, all against each other.
    """
    sizes = np.array([len(s) for s in sets])
    places, found = places.copy(), []
    for k in range(split or len(sets) - 1):
        others = max(split, k + 1) + np.flatnonzero(places[max(split, k + 1) :] != places[k])
        least, most = np.minimum(sizes[others], sizes[k]), np.maximum(sizes[others], sizes[k])
        others = others[100 * least >= share * most]
        others = others[(sigs[others] != sigs[k]).sum(1) <= FARTHEST]
        if not len(others):
            continue
        ends = np.cumsum(sizes[others])
        values = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(sets[k], values), sizes[k] - 1)
        shared = np.add.reduceat(sets[k][at] == values, ends - sizes[others], dtype=np.int64)
        for j in others[100 * shared >= share * (sizes[others] + sizes[k] - shared)]:
            if places[j] != places[k]:
                found.append((k, int(j)))
                places[places == places[j]] = places[k]
    return found


def linked_within(rest: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between members of one entry that are in different components.

    ``rest`` has (first, rep, component): the smallest member of an entry, and each member; entries with one
    smallest member are one group. A group's sets are dealt into blocks of about ``BLOCK`` bytes and
    ``MEMBERS`` members, and each two blocks meet in one task, so what a task holds is bounded and no rows are
    made of pairs. ``sets`` has (rep, shingles, sig).
    """
    sized = rest.join(sets.select("rep", F.octet_length("shingles").alias("bytes")), "rep")
    blocks = sized.groupBy("first").agg(
        F.greatest(F.ceil(F.sum("bytes") / BLOCK), F.ceil(F.count("*") / MEMBERS)).cast("int").alias("blocks")
    )
    dealt = rest.join(blocks, "first").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.join(sets, "rep")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("rep", "ascending")])
        reps, block = group.column("rep").to_numpy(), group.column("block").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(reps), -1)
        split = int(np.searchsorted(block, block[0], "right")) if block[0] != block[-1] else 0
        found = _crossing(sets, sigs, group.column("component").to_numpy(), split, share)
        return pa.table({"a": reps[[i for i, _ in found]], "b": reps[[j for _, j in found]]}, LINKS)

    columns = ["first", "low", "high", "rep", "component", "block", "shingles", "sig"]
    return dealt.select(columns).groupBy("first", "low", "high").applyInArrow(run, "a long, b long")


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the component that each ``rep`` is in."""
    found = members.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return found.withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    docs = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    found = written(described(docs, width), "sets")
    classes = found.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    # Classes are numbered, as one id may stand over several texts; the table is written, so numbers stay.
    classes = classes.where("low is not null").withColumn("rep", F.monotonically_increasing_id())
    classes = written(classes, "classes")
    keys = entered(classes)
    shared = keys.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    members = written(keys.join(shared.select("key", "first"), "key"), "members")
    several = classes.join(members.select("rep").distinct(), "rep", "left_semi")
    sets = written(sets_of(several.select("rep", "low", "digest"), docs, width), "sets")

    # What is open: classes whose entry's first class is in another component and was not met yet.
    waiting = members.where("rep <> first").groupBy("first", "rep").agg(F.count("*").alias("shared"))
    labels = None
    for _ in range(ROUNDS):
        likeliest = F.max_by("first", F.struct("shared", -F.col("first")))
        pairs = waiting.groupBy(F.col("rep").alias("b")).agg(likeliest.alias("a"))
        pairs = written(pairs.select("a", "b"), "pairs")
        links = confirmed(written(close(pairs, classes, share), "pairs"), sets, share)
        labels = written(components(links), "labels") if labels is None else merged(labels, written(links, "links"))
        waiting = waiting.join(pairs.select(F.col("a").alias("first"), F.col("b").alias("rep")), ["first", "rep"], "left_anti")
        waiting = _placed(waiting, labels).withColumnRenamed("component", "place")
        firsts = _placed(waiting.select(F.col("first").alias("rep")).distinct(), labels)
        waiting = waiting.join(firsts.select(F.col("rep").alias("first"), "component"), "first")
        waiting = written(waiting.where("place <> component").select("first", "rep", "shared"), "waiting")

    # Entries whose members are still in different components hold pairs not yet held against each other.
    placed = _placed(members.select("key", "first", "rep"), labels)
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    rest = placed.join(mixed.where("least < most").select("key"), "key", "left_semi")
    rest = written(rest.select("first", "rep", "component").distinct(), "rest")
    later = linked_within(rest, sets.join(classes.select("rep", "sig"), "rep"), share)
    labels = merged(labels, written(later, "links"))

    where = _placed(classes.select("digest", "rep", "low"), labels)
    lowest = where.groupBy("component").agg(F.min("low").alias("component_id"))
    where = written(where.join(lowest, "component").select("digest", "component_id"), "components")
    out = found.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(where, "digest", "left")
    # An empty set has a digest but no class.
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )
