"""Connected components of links between ids, by Spark joins.

In each round every id points to its smallest neighbour, if that is smaller, and pointers are followed to
their ends by doubling. The ends are the ids of the next round, and only links between different ends go on,
each once. So a round is smaller than the one before, a group of many copies is one id after one round, and
an id with very many links costs no more than its links, which are summed up before they are shuffled. Every
table of a round is written; what the driver learns is whether rows are left.

Defined results: links of an id to itself and repeated links change nothing; an id without links gives no
row; null ends are dropped; no links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirespan.llm.tables import written


def _some(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def _ends(pointers: DataFrame) -> DataFrame:
    """``pointers`` (id, up), each followed to its end, an id that points to itself."""
    while True:
        above = pointers.select(F.col("id").alias("up"), F.col("up").alias("next"))
        further = written(pointers.join(above, "up").select("id", F.col("next").alias("up"), (F.col("next") < F.col("up")).alias("moved")), "labels")
        pointers = further.select("id", "up")
        if not _some(further.where("moved")):
            return pointers


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the component is its smallest id."""
    rounds = []
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while _some(links):
        ways = links.union(links.select("b", "a"))
        pointers = ways.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("up"))
        ends = _ends(written(pointers, "labels"))
        rounds.append(ends)
        for end in "ab":
            links = links.join(ends.select(F.col("id").alias(end), F.col("up").alias(f"{end}_up")), end)
        links = links.where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        links = written(links.distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = rounds.pop().withColumnRenamed("up", "component")
    while rounds:  # an end may have no link in the next round
        labels = labels.withColumnRenamed("id", "up")
        labels = rounds.pop().join(labels, "up", "left").select("id", F.coalesce("component", "up").alias("component"))
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) with the components that further ``links`` (a, b) of ids connect made one."""
    for end in "ab":
        of = labels.select(F.col("id").alias(end), F.col("component").alias("to"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    joined = written(components(links), "labels")
    found = labels.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    found = found.select("id", F.coalesce("to", "component").alias("component"))
    alone = joined.join(labels.select("id"), "id", "left_anti")  # ids that had no label
    return written(found.union(alone.select("id", "component")), "labels")
