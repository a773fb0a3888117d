"""Date windows and ordered, bounded scans."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import fixed_values as fixed
from caseflow.functions.times import parse_column
from caseflow.operators import selection


def _day(text: Column) -> Column:
    """The calendar day at the start of an ISO date or date-time text."""
    return F.try_to_date(F.substring(F.trim(text.cast("string")), 1, 10), "yyyy-MM-dd")


def normalize_window(start: Column, end: Column, as_of: Column) -> tuple[Column, Column]:
    """(start, end) days: swapped if reversed, neither after ``as_of``.

    Works row by row, so a whole table of windows can be normalised. A bound
    that is absent or unreadable stays NULL and leaves the other one in place.
    """
    first, last = _day(start), _day(end)
    both = first.isNotNull() & last.isNotNull()
    low = F.when(both, F.least(first, last)).otherwise(first)
    high = F.when(both, F.greatest(first, last)).otherwise(last)
    capped = F.when(high.isNotNull(), F.least(high, as_of))
    return F.when(capped.isNotNull() & low.isNotNull(), F.least(low, capped)).otherwise(low), capped


def window_days(
    start: str | date | None = None,
    end: str | date | None = None,
    as_of: date | None = None,
    days: int = fixed.WINDOW_DAYS,
) -> tuple[date, date]:
    """The same rules for one window given when the plan is built.

    Bounds left out mean the ``days`` days up to ``as_of`` (today by default).
    """
    today = as_of or date.today()

    def parsed(value: str | date | None, default: date) -> date:
        return default if value is None else date.fromisoformat(str(value).strip()[:10])

    low, high = sorted((parsed(start, today - timedelta(days=days)), parsed(end, today)))
    high = min(high, today)
    return min(low, high), high


def _moment(text: datetime, kind: T.DataType) -> Column:
    """A literal of a timestamp column's own type, which Parquet filters need."""
    cast = "timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz"
    return F.lit(text.isoformat(" ")).cast(cast)


def in_window(
    df: DataFrame,
    column: str,
    start: date,
    end: date,
    formats: Sequence[str] = fixed.TIMESTAMP_FORMATS,
    day_column: str | None = None,
) -> Column:
    """From the first second of ``start`` to the last whole second of ``end``.

    The bounds are literals of the column's type, so the test reaches the scan.
    Whether Parquet skips row groups by it depends on the type: Spark does so for
    ``timestamp``, dates and texts, not for ``timestamp_ntz``. ``day_column``, a date
    column by which the table is partitioned, prunes folders for every type.

    Texts are parsed by ``formats``. If all of these begin with the day, a plain
    text range that lets through at least the window comes first.
    """
    low = datetime.combine(start, datetime.min.time())
    high = datetime.combine(end, datetime.max.time()).replace(microsecond=0)
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        inside = F.col(column).between(_moment(low, kind), _moment(high, kind))
    elif isinstance(kind, T.DateType):
        inside = F.col(column).between(F.lit(start), F.lit(end))
    else:
        parsed = parse_column(df, column, formats)
        inside = parsed.between(_moment(low, T.TimestampNTZType()), _moment(high, T.TimestampNTZType()))
        if isinstance(kind, T.StringType) and formats and all(f.startswith("yyyy-MM-dd") for f in formats):
            inside = (F.col(column) >= start.isoformat()) & inside
            if end < date.max:
                inside = (F.col(column) < (end + timedelta(days=1)).isoformat()) & inside
    if day_column is not None:
        inside = F.col(day_column).between(F.lit(start), F.lit(end)) & inside
    return inside


def tie_columns(df: DataFrame, ties: Sequence[str] = ()) -> list[str]:
    """``ties`` and then all other columns that can be ordered: a total order of different rows."""
    rest = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rest = [f for f in rest if "variant" not in df.schema[f].dataType.simpleString()]
    return [*ties, *[c for c in rest if c not in ties]]


def first_rows(
    df: DataFrame, order: Column, ties: Sequence[str], limit: int | None, ordered: bool = True
) -> DataFrame:
    """The first ``limit`` rows by a numeric key; all rows, sorted, without a limit.

    A caller that needs no order says so with ``ordered=False``: all rows then come as
    they are read, without a sort or shuffle.

    Rows without a key come last. A plain sort with limit sends up to ``limit``
    rows of *every* input split to one task. Up to ``SPREAD_FROM`` rows, two steps keep
    that task small: rows are cut to the slot (hour) of the key in which the limit is
    reached, and what is left is limited per split, then per bucket of splits, before it
    meets. So one task sees ``limit`` rows per bucket, even if all rows fall in one hour.
    For larger limits the exact cut is searched at once, by histograms of the key and then
    of the ties, and the result stays spread over tasks (``selection.smallest_rows``).
    """
    by = [order.asc_nulls_last(), *[F.col(f"`{c}`").asc_nulls_last() for c in ties]]
    if limit is None or limit <= 0:
        return df.orderBy(*by) if ordered else df
    if limit > SPREAD_FROM:
        return selection.smallest_rows(df, order, ties, limit, ordered)
    slot = F.coalesce(F.floor(order / _SLOT_MICROS), F.lit(_LAST_SLOT))
    counts = df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # one row per hour that has rows, so this window stays small
    before = F.sum("n").over(
        Window.partitionBy(F.lit(1)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = (
        counts.withColumn("before", F.coalesce(before, F.lit(0)))
        .filter(F.col("before") < limit)
        .agg(F.max("slot"))
    )
    return selection.leading_rows(df.filter(slot <= cut.scalar()), by, limit)


#: Limits above this are searched for when the scan is built.
SPREAD_FROM = 10_000
_SLOT_MICROS = 3_600_000_000
_LAST_SLOT = 2**63 - 1


def _micros(df: DataFrame, column: str, formats: Sequence[str]) -> Column:
    return F.unix_micros(parse_column(df, column, formats).cast("timestamp"))


def window_scan(
    df: DataFrame,
    column: str,
    start: date,
    end: date,
    limit: int | None = None,
    ties: Sequence[str] = (),
    formats: Sequence[str] = fixed.TIMESTAMP_FORMATS,
    day_column: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Rows of the window, oldest first: all of them, or the first ``limit``.

    Ties are settled by ``ties`` and then by all other columns. ``ordered=False`` gives
    the same rows in no order.
    """
    inside = df.filter(in_window(df, column, start, end, formats, day_column))
    return first_rows(inside, _micros(df, column, formats), tie_columns(df, ties), limit, ordered)


def window_scan_or_latest(
    df: DataFrame,
    column: str,
    start: date,
    end: date,
    limit: int | None = None,
    ties: Sequence[str] = (),
    formats: Sequence[str] = fixed.TIMESTAMP_FORMATS,
    day_column: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """``window_scan``, or the latest rows of the table if the window is empty.

    One lazy plan: the rows of the window, under the pushed-down filter, and all
    rows semi-joined with a frame that has one row if the window is empty and none
    otherwise. On a hit adaptive execution drops the second part unread.
    """
    inside = in_window(df, column, start, end, formats, day_column)
    micros = _micros(df, column, formats)
    hit = df.filter(inside).withColumn("_order", micros)
    empty = df.filter(inside).limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n < 1")
    # both keys are always 0, yet no constants, so that this is an equi-join
    flag = F.broadcast(empty.select(F.col("n").cast("int").alias("_flag")))
    latest = df.withColumn("_order", -micros).withColumn("_flag", F.pmod(F.hash(F.col(column)), F.lit(1)))
    latest = latest.join(flag, "_flag", "left_semi").drop("_flag")
    return first_rows(hit.unionByName(latest), F.col("_order"), tie_columns(df, ties), limit, ordered).drop("_order")
