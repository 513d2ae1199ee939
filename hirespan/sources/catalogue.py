"""Reference tables that a caller brings along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirespan.sources.store import has_rows, write_table


def hardest_first(benchmarks: DataFrame) -> DataFrame:
    """Reference jobs, hardest first; ties by company, then title."""
    return benchmarks.orderBy(F.col("difficulty_level").desc(), "company", "title")


def load_if_empty(rows: DataFrame, path: str) -> bool:
    """Write the rows unless the table at ``path`` already has some; true if written."""
    if has_rows(rows.sparkSession, path):
        return False
    write_table(rows, path)
    return True
