"""Generic helpers on any DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def group_by(
    df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, str] | None = None
) -> DataFrame:
    """``{column: function}`` aggregates per key, or the distinct keys."""
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(dict(aggregates))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))
