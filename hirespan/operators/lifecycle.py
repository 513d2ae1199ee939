"""Life cycles: the state of each key, folded over its ordered log of steps.

A step leads to a state and is legal from some states only; an illegal one is rejected and changes nothing. A
stretch of a log thus is a function from the state before it to the state after it, and such functions
compose. So the log of a heavy key is cut into slices which are folded at the same time, once for every state
they might begin in; a table of a row per slice then says in which state each of them does begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from hirespan.operators.skew import with_order_slices
from hirespan.schemas import ALLOWED

NONE = ""  # before the first step
# Which states may follow a state.
RESUME = {
    NONE: ["UPLOADED"],
    "UPLOADED": ["PROCESSING"],
    "PROCESSING": ["PARSED", "FAILED"],
    "PARSED": ["PROCESSING"],
    "FAILED": ["PROCESSING"],
}
# An application is scored on arrival if at all; later its owner may set any state but these two.
_SET = [status for status in ALLOWED["applications", "status"] if status not in ("APPLIED", "SCORED")]
APPLICATION = {NONE: ["APPLIED"], "APPLIED": ["SCORED", *_SET], "SCORED": _SET, **{status: _SET for status in _SET}}


def steps(
    log: DataFrame, key: str, legal: dict[str, list[str]], order: list[str], status: str = "status",
    parts: int | None = None, floor: int = 0,
) -> DataFrame:
    """``log`` with ``state_before`` and whether the step was ``accepted``.

    ``order`` must be unique within a key. Rows without a key or status are rejected from no state at all.
    """
    names = log.columns
    known = log.where(F.col(key).isNotNull() & F.col(status).isNotNull())
    sliced = with_order_slices(known, key, order, parts, floor)
    states = sorted({*legal, *(s for after in legal.values() for s in after)})

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(key, "slice").sortWithinPartitions(key, "slice", *order)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = None, []
        for batch in batches:
            out = []
            for this, step in zip(zip(*_lists(batch, key, "slice"), strict=True), batch.column(status).to_pylist(), strict=True):
                if this != run:
                    out += [(run, at)] if run else []
                    run, at = this, list(states)
                at = [step if step in legal.get(s, ()) else s for s in at]
            yield _slices(out)
        yield _slices([(run, at)] if run else [])

    pair = StructType([known.schema[key], sliced.schema["slice"]])
    kinds = [_type(field) for field in pair]

    def _slices(found: list) -> pa.RecordBatch:
        keys, numbers, after = zip(*[(*run, at) for run, at in found], strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array(numbers, kinds[1]), pa.array(after, pa.list_(pa.string()))], [key, "slice", "ends"])

    heavy = in_order(sliced.where("is_sliced")).mapInArrow(ends, StructType([*pair, StructField("ends", ArrayType(StringType()))]))
    # Slices of a key: at most a few for each part, so their table is small.
    place = F.create_map(*[x for k, s in enumerate(states) for x in (F.lit(s), F.lit(k))])

    def through(state, ends):
        return F.get(ends, F.try_element_at(place, state))

    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = heavy.withColumn("before", F.collect_list("ends").over(earlier))
    begun = begun.select(key, "slice", F.aggregate("before", F.lit(NONE), through).alias("_start"))
    rows = in_order(sliced.join(begun, [key, "slice"], "left").withColumn("_start", F.coalesce("_start", F.lit(NONE))))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, state = None, NONE
        for batch in batches:
            before, accepted = [], []
            for this, start, step in zip(zip(*_lists(batch, key, "slice"), strict=True), *_lists(batch, "_start", status), strict=True):
                if this != run:
                    run, state = this, start
                before.append(state)
                accepted.append(step in legal.get(state, ()))
                state = step if accepted[-1] else state
            columns = [*batch.select(names).columns, pa.array(before, pa.string()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "state_before", "accepted"])

    added = [StructField("state_before", StringType()), StructField("accepted", BooleanType())]
    folded = rows.select(*names, "slice", "_start").mapInArrow(fold, StructType([*log.schema.fields, *added]))
    unknown = log.where(F.col(key).isNull() | F.col(status).isNull())
    return folded.unionByName(unknown.withColumns({"state_before": F.lit(None).cast("string"), "accepted": F.lit(False)}))


def _lists(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(name).to_pylist() for name in names]


def _type(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def current(folded: DataFrame, key: str, order: list[str], status: str = "status") -> DataFrame:
    """Per key its present ``state``, and how many ``steps`` were accepted and ``rejected``."""
    last = F.max_by(F.when(F.col("accepted"), F.col(status)), F.when(F.col("accepted"), F.struct(*order)))
    return (
        folded.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(last.alias("state"), F.count_if("accepted").alias("steps"), F.count_if(~F.col("accepted")).alias("rejected"))
        .withColumn("state", F.coalesce("state", F.lit(NONE)))
    )


def rejects(folded: DataFrame) -> DataFrame:
    """Steps that were not legal, with the reason."""
    unknown = F.col("state_before").isNull()
    reason = F.when(unknown, "key or state is missing").otherwise("step is not legal from this state")
    return folded.where(~F.col("accepted")).withColumn("reason", reason)
