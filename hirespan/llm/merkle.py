"""A manifest of a dataset as a binary hash tree with a proof for every record.

Every node carries the interval of leaf ranks that it covers, from ``lo`` up to ``hi``. A node's parent is
the one interval of the level above that contains it, and its siblings are what is left of the parent's
interval without its own. Levels are joined in buckets of ``BAND``: the nodes of a bucket's lowest level that
lie in one interval of 2**BAND nodes meet in one group, which climbs the bucket's levels and gives each of
them its path (a sibling's digest and side for each level), and the digest of the interval, which is a node
of the next bucket. Then paths are attached downwards: a node's path within its bucket, then that of the
interval containing it. Each such join has 2**BAND rows a key, whatever the size of a tree, so neither a
tree that holds all records nor its root makes a hot key. There are log(records) / BAND such steps.

Trees are ranked by a sort over ranges, with counts per range and tree; no tree is brought into one task.
Their tops are ranked by tree name and form the upper tree in the same way.

Defined results: a null name of a tree is a tree of its own and comes first; null ids come first within a
tree; rows with equal ids are ordered by their leaf's digest, so equal rows may change places without any
effect. A record without siblings has the digest of nothing as its proof. An empty table gives an empty
one. Further columns of the records are carried on, whatever their names; one that is named like a result
(``subroot``, ``root``, ``path``, ``proof_sha256``) gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirespan.llm.tables import small_batches, written

BAND = 10
CLIMBED = pa.schema([
    ("tree", pa.string()), ("lo", pa.int64()), ("n", pa.int64()), ("path", pa.list_(pa.string())),
    ("top_lo", pa.int64()), ("top", pa.string()),
])


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """Length in bytes, a colon and the value as text; a lone dash for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def record(*values: Column) -> Column:
    """The digest of a record, from the fields in order."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of (tree, ...) with ``lo``, their rank within the tree, and ``n``, the tree's number of rows.

    Rows are sorted over ranges of (tree, order); a row's rank is its place in its range plus the tree's rows in
    earlier ranges. The table that says so has one row per range and tree that meet.
    """
    keys = ["tree", *order]
    place = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The id holds the partition's number and the place in it; the table is written, so ids stay.
    place = written(place.withColumn("place", F.monotonically_increasing_id()), "places")
    place = place.withColumn("range", F.shiftright("place", 33))
    runs = place.groupBy("tree", "range").agg(F.count("*").alias("here"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("here").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "range", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(tree).alias("n"))
    found = place.join(runs, ["tree", "range"])
    return found.withColumn("lo", F.expr("before + place - first")).drop("range", "place", "first", "before")


def climb(lows: list[int], digests: list[str], height: int, levels: int | None) -> tuple[list[list[str]], str]:
    """The path of each node up to the one that covers them all, and that one's digest.

    ``lows`` are where the nodes' intervals start, ``height`` their level. ``levels`` says how far to climb
    if the tree goes on above; without it the climb ends where one node is left.
    """
    level = dict(zip(lows, digests, strict=True))
    above = {lo: lo for lo in lows}  # where the interval that holds a node starts, on the level reached
    paths: dict[int, list[str]] = {lo: [] for lo in lows}
    climbed = 0
    while climbed < levels if levels is not None else len(level) > 1:
        width = 1 << (height + climbed)
        parents: dict[int, list[int]] = {}
        for lo in level:
            parents.setdefault(lo - lo % (2 * width), []).append(lo)
        for lo, at in above.items():
            parent = at - at % (2 * width)
            other = [x for x in parents[parent] if x != at]  # the parent's interval without the node's own
            paths[lo].append(("L" if other[0] < at else "R") + level[other[0]] if other else "")
            above[lo] = parent
        level = {parent: H(*[level[x] for x in inside]) for parent, inside in parents.items()}
        climbed += 1
    return [paths[lo] for lo in lows], next(iter(level.values()))


def _band(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, lo, n, path, top_lo, top) of ``nodes`` (tree, lo, n, digest), all of level ``height``."""
    most = 1 << (height + BAND)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("lo")
        lows, n = group.column("lo").to_pylist(), group.column("n")[0].as_py()
        paths, top = climb(lows, group.column("digest").to_pylist(), height, BAND if n > most else None)
        columns = [group.column("tree"), group.column("lo"), group.column("n"), paths, [group.column("bucket")[0].as_py() * most] * len(lows), [top] * len(lows)]
        return pa.table(dict(zip(CLIMBED.names, columns, strict=True)), CLIMBED)

    nodes = nodes.select("tree", F.shiftright("lo", height + BAND).alias("bucket"), "lo", "n", "digest")
    schema = "tree string, lo long, n long, path array<string>, top_lo long, top string"
    return nodes.groupBy("tree", "bucket").applyInArrow(run, schema)


def paths(leaves: DataFrame) -> list[DataFrame]:
    """For ``leaves`` (tree, lo, n, digest), a table of paths for each bucket of levels, from the lowest up."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    bands: list[DataFrame] = []
    nodes, height = leaves, 0
    while True:
        bands.append(written(_band(nodes, height), "band"))
        height += BAND
        if most <= 1 << height:
            return bands
        nodes = bands[-1].where(f"n > {1 << height} and lo = top_lo").select("tree", "lo", "n", F.col("top").alias("digest"))


def attached(bands: list[DataFrame], upper: DataFrame) -> DataFrame:
    """(tree, lo, path, subroot, root) of every leaf: its path up to the root of all trees.

    ``upper`` has (tree, subroot, root, path) of every tree's top. It meets the last bucket's nodes of a tree
    only, at most 2**BAND of them; everything below takes it from the interval above.
    """
    whole = None
    for k in range(len(bands) - 1, -1, -1):
        limit = 1 << (BAND * (k + 1))
        here = bands[k]
        last = here.where(f"n <= {limit}")
        last = last.join(upper.withColumnRenamed("path", "on"), "tree").select(
            "tree", "lo", F.concat("path", "on").alias("path"), "subroot", "root"
        )
        if whole is not None:
            on = whole.select("tree", F.col("lo").alias("top_lo"), F.col("path").alias("on"), "subroot", "root")
            inner = here.where(f"n > {limit}").join(on, ["tree", "top_lo"])
            last = last.unionByName(inner.select("tree", "lo", F.concat("path", "on").alias("path"), "subroot", "root"))
        whole = last
    return whole


def tops(bands: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the node that covers all of a tree."""
    out = None
    for k, band in enumerate(bands):
        some = band.where(f"lo = 0 and n <= {1 << (BAND * (k + 1))}").select("tree", F.col("top").alias("digest"))
        out = some if out is None else out.unionByName(some)
    return out


def folded(start: Column, path: Column) -> Column:
    """The digest at the end of a path that begins with ``start``."""

    def step(below: Column, sibling: Column) -> Column:
        digest = F.substring(sibling, 2, 64)
        both = F.when(sibling.startswith("L"), F.concat(digest, below)).when(sibling.startswith("R"), F.concat(below, digest))
        return F.sha2(F.coalesce(both, below).cast("binary"), 256)

    return F.aggregate(path, start, step)


def manifest(records: DataFrame, tree: str, order: list[str], leaf: str) -> DataFrame:
    """``records`` with ``subroot``, ``root``, ``path`` (siblings from the leaf up) and ``proof_sha256``.

    ``tree`` and ``leaf`` name columns: which tree a record is in (may be null), and its digest.
    """
    small_batches(records.sparkSession)
    results = ["subroot", "root", "path", "proof_sha256"]
    carried = F.struct(*[F.col(f"`{c}`") for c in records.columns if c not in results])
    # Null comes before any name, and names keep their order by bytes.
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`")), F.lit(""))
    keys = [F.col(f"`{c}`").alias(f"key{k}") for k, c in enumerate(order)]
    rows = records.select(carried.alias("record"), name.alias("tree"), *keys, F.col(f"`{leaf}`").alias("digest"))
    rows = ranked(written(rows, "leaves"), [*[f"key{k}" for k in range(len(order))], "digest"])
    rows = written(rows.select("record", "tree", "lo", "n", "digest"), "ranked")
    bands = paths(rows.drop("record"))

    trees = tops(bands).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    trees = written(ranked(trees, ["name"]), "trees")
    above = paths(trees.select("tree", "lo", "n", "digest"))
    no_more = tops(above).select("tree", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<string>").alias("path"))
    upper = attached(above, no_more).join(trees.select("tree", "lo", "name", "digest"), ["tree", "lo"])
    upper = upper.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")

    proofs = attached(bands, written(upper, "upper"))
    found = rows.select("record", "tree", "lo").join(proofs, ["tree", "lo"])
    siblings = F.array_join(F.transform("path", lambda x: F.substring(x, 2, 64)), "")
    return found.select("record.*", *results[:3], F.sha2(siblings.cast("binary"), 256).alias(results[3]))
