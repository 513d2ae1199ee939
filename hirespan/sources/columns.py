"""List and map columns stored as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirespan.functions.text import trim_space


def _or_none(text: Column) -> Column:
    return F.nullif(trim_space(text), F.lit(""))


def read_list(text: Column) -> Column:
    """A list of texts; null or blank gives an empty list."""
    return F.coalesce(F.from_json(_or_none(text), "array<string>"), F.array().cast("array<string>"))


def read_map(text: Column, values: str = "string") -> Column:
    """A map from text; null or blank gives an empty map."""
    kind = f"map<string,{values}>"
    return F.coalesce(F.from_json(_or_none(text), kind), F.create_map().cast(kind))


def write_json(value: Column, kind: str) -> Column:
    """JSON text of a list or map; null is written as an empty one."""
    empty = F.array() if kind.startswith("array") else F.create_map()
    return F.to_json(F.coalesce(value, empty.cast(kind)))
