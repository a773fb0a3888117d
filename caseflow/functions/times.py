"""Timestamps, days and ages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import fixed_values as fixed

# formats whose texts a plain cast reads the same way, with the shape of such a text
_CASTABLE = {
    "yyyy-MM-dd'T'HH:mm:ss": r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d",
    "yyyy-MM-dd HH:mm:ss": r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d",
    "yyyy-MM-dd": r"\d{4}-\d\d-\d\d",
}
# the first whole years, after and before 0, that a timestamp cannot hold
_YEARS_END = 294247
_YEARS_START = 290308


def _by_format(raw: Column, formats: Sequence[str]) -> list[Column]:
    return [F.try_to_timestamp(raw, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]


def _by_cast(raw: Column, formats: Sequence[str]) -> list[Column]:
    """The same result as ``_by_format``, several times as fast.

    Reading by a pattern is slow, and a text that does not fit costs an
    exception. Texts of the exact shape are cast instead. What else these
    patterns accept is rare and read by them: a small ``t``, and signed years,
    which stand for years before 0 or of more than four digits. Years beyond
    the range of a timestamp count as unreadable; read by pattern, one such
    value would end the job with an overflow.
    """
    shape = "|".join(_CASTABLE[fmt] for fmt in formats)
    usual = F.when(raw.rlike(rf"\A(?:{shape})\z"), raw.try_cast("timestamp_ntz"))
    signed_year = F.substring_index(F.substring(raw, 2, 20), "-", 1).try_cast("int")
    rare = (
        (F.substring(raw, 11, 1) == "t")
        | (raw.startswith("+") & (signed_year < _YEARS_END))
        | (raw.startswith("-") & (signed_year < _YEARS_START))
    )
    return [usual, F.when(rare, F.coalesce(*_by_format(raw, formats)))]


def parse_timestamp(raw: Column, formats: Sequence[str] = fixed.TIMESTAMP_FORMATS) -> Column:
    """First format that reads the text wins; NULL if none does.

    The value is a wall-clock time without zone; run with the session time
    zone set to UTC.
    """
    tries: list[Column] = []
    for castable, group in groupby(formats, key=_CASTABLE.__contains__):
        tries += (_by_cast if castable else _by_format)(raw, list(group))
    if not tries:
        tries = [F.try_to_timestamp(raw).cast("timestamp_ntz")]
    return F.coalesce(*tries)


def parse_column(
    df: DataFrame, name: str, formats: Sequence[str] = fixed.TIMESTAMP_FORMATS
) -> Column:
    """A column as wall-clock time: texts by ``formats``, dates and timestamps as they are."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    raw = F.col(name)
    return parse_timestamp(raw if isinstance(kind, T.StringType) else raw.cast("string"), formats)


def parse_failed(raw: Column, parsed: Column) -> Column:
    return F.when(raw.isNotNull() & parsed.isNull(), 1).otherwise(0)


def as_of_day(as_of: str | date | Column | None) -> Column:
    """The day that ages are counted from: today unless the caller fixes it."""
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def age_in_days(created_day: Column, as_of: str | date | Column | None) -> Column:
    return F.datediff(as_of_day(as_of), created_day)


def age_bucket(age_days: Column) -> Column:
    bucket = F.when(age_days.isNull(), fixed.UNKNOWN_BUCKET)
    for largest, label in fixed.AGE_BUCKETS:
        bucket = bucket.when(age_days <= largest, label)
    return bucket.otherwise(fixed.OLDEST_BUCKET)


def age_bucket_rank(bucket: Column) -> Column:
    labels = [label for _, label in fixed.AGE_BUCKETS] + [fixed.OLDEST_BUCKET]
    rank = F.when(bucket == labels[0], 1)
    for position, label in enumerate(labels[1:], start=2):
        rank = rank.when(bucket == label, position)
    return rank.otherwise(len(labels) + 1)
