"""Row-level features: parsed times, resolution days, SLA breach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import fixed_values as fixed
from caseflow.functions.times import parse_column, parse_failed


def add_times(df: DataFrame, formats: Sequence[str] = fixed.TIMESTAMP_FORMATS) -> DataFrame:
    """``created_ts``, ``due_ts``, ``closed_ts`` and their parse-failed flags."""
    stems = [field.removesuffix("_date") for field in fixed.DATE_FIELDS]
    parsed = df.withColumns(
        {f"{s}_ts": parse_column(df, f"{s}_date", formats) for s in stems}
    )
    return parsed.withColumns(
        {
            f"{s}_ts_parse_failed": parse_failed(F.col(f"{s}_date"), F.col(f"{s}_ts"))
            for s in stems
        }
    )


def sla_breach(created: Column, due: Column, closed: Column) -> Column:
    """1 closed late, 0 in time; NULL if a time is missing or out of order."""
    in_order = (due >= created) & (closed >= created)
    return F.when(in_order, (closed > due).cast("int"))


def add_resolution(df: DataFrame) -> DataFrame:
    """Days to close (negative if closed first), completed flag, SLA breach."""
    created, due, closed = F.col("created_ts"), F.col("due_ts"), F.col("closed_ts")
    return df.withColumns(
        {
            "resolution_time_days": F.datediff(closed, created),
            "resolution_completed": closed.isNotNull().cast("int"),
            "sla_breach": sla_breach(created, due, closed),
        }
    )


def add_features(df: DataFrame, formats: Sequence[str] = fixed.TIMESTAMP_FORMATS) -> DataFrame:
    return add_resolution(add_times(df, formats))
