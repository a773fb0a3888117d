"""Schema and quality checks: one aggregate pass over the records.

``field_quality`` gives one row per required field, ``verdict`` one row for
the table, ``gate`` lets rows through only if the verdict is valid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import fixed_values as fixed
from caseflow.functions.scores import percent_text
from caseflow.functions.texts import filled, quoted
from caseflow.functions.times import parse_column
from caseflow.operators.schema import alias_map, alias_warnings, missing_fields

_NO_NAMES = "CAST(array() AS array<string>)"


def count_columns(df: DataFrame, formats: Sequence[str] = fixed.TIMESTAMP_FORMATS) -> list[Column]:
    """The aggregates behind a verdict on ``df``, by ``agg`` or by ``observe``."""
    counts = [F.count(F.lit(1)).alias("row_count")]
    if not missing_fields(df):
        counts += [F.count(F.when(F.col(f).isNull(), 1)).alias(f"null_{f}") for f in fixed.REQUIRED_FIELDS]
        counts += [
            F.count(F.when(F.col(f).isNotNull() & parse_column(df, f, formats).isNull(), 1)).alias(f"bad_{f}")
            for f in fixed.DATE_FIELDS
        ]
    return counts


def _field_stats(df: DataFrame, formats: Sequence[str], counted: DataFrame | None = None) -> DataFrame:
    """One row: row count and an array with the figures of each required field.

    The figures stay 0 and unflagged if the table is empty or lacks a field. ``counted``
    has the ``count_columns`` if they are known already.
    """
    missing = missing_fields(df)
    checked = str(not missing).lower()
    listed = []
    for position, field in enumerate(fixed.REQUIRED_FIELDS):
        nulls = "0L" if missing else f"null_{field}"
        malformed = f"bad_{field}" if not missing and field in fixed.DATE_FIELDS else "0L"
        listed.append(
            f"named_struct('position', {position}, 'field', '{field}',"
            f" 'present', {str(field not in missing).lower()},"
            f" 'null_count', {nulls}, 'malformed_count', {malformed})"
        )
    counted_rows = df.agg(*count_columns(df, formats)) if counted is None else counted
    return counted_rows.selectExpr(
        "row_count",
        f"""transform(array({", ".join(listed)}), f -> named_struct(
          'position', f.position, 'field', f.field, 'present', f.present,
          'null_count', f.null_count,
          'null_rate', coalesce(try_divide(f.null_count, row_count), 0.0D),
          'malformed_count', f.malformed_count,
          'all_null', {checked} AND row_count > 0 AND f.null_count = row_count,
          'high_null', {checked} AND row_count > 0 AND f.null_count < row_count
                       AND f.null_count / row_count >= {fixed.HIGH_NULL_RATE}D)) AS fields""",
    )


def field_quality(
    df: DataFrame, formats: Sequence[str] = fixed.TIMESTAMP_FORMATS
) -> DataFrame:
    """One row per required field: NULLs, malformed dates, flags."""
    return _field_stats(df, formats).select("row_count", F.inline("fields"))


def verdict(
    df: DataFrame,
    renames: dict[str, str] | None = None,
    formats: Sequence[str] = fixed.TIMESTAMP_FORMATS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """One row: is the table valid, and why not.

    ``renames`` is the alias map that led to ``df``; its entries become
    warnings. Malformed dates are errors, a high share of NULLs is a warning.
    """
    missing = missing_fields(df)
    renames = renames or {}

    def names(items: Sequence[str]) -> str:
        return "array(" + ", ".join(quoted(i) for i in items) + ")" if items else _NO_NAMES

    absent = [fixed.MISSING_MESSAGE.format(fields=", ".join(missing))] if missing else []
    is_date = "f.field IN (" + ", ".join(quoted(d) for d in fixed.DATE_FIELDS) + ")"
    return (
        _field_stats(df, formats, counted)
        .selectExpr(
            "row_count",
            "fields",
            f"""array_compact(concat(
              array(CASE WHEN row_count = 0 THEN {quoted(fixed.EMPTY_MESSAGE)} END),
              {names(absent)},
              transform(fields, f -> CASE WHEN f.all_null
                THEN {filled(fixed.ALL_NULL_MESSAGE, field="f.field")} END),
              transform(fields, f -> CASE WHEN f.malformed_count > 0
                THEN {filled(fixed.MALFORMED_MESSAGE, field="f.field", count="f.malformed_count")}
                END))) AS errors""",
            f"""array_compact(concat(
              {names(alias_warnings(renames))},
              transform(fields, f -> CASE WHEN f.high_null
                THEN {filled(fixed.HIGH_NULL_MESSAGE, field="f.field", rate=percent_text("f.null_rate"))}
                END))) AS warnings""",
        )
        .selectExpr(
            "size(errors) = 0 AS is_valid",
            "row_count",
            "errors",
            "warnings",
            f"{names(fixed.REQUIRED_FIELDS)} AS required_fields",
            f"{names(df.columns)} AS available_fields",
            f"{names(missing)} AS missing_fields",
            f"map_from_arrays({names(list(renames))}, {names(list(renames.values()))})"
            " AS alias_resolution",
            "map_from_arrays(fields.field, fields.null_count) AS null_counts",
            "map_from_arrays(fields.field, fields.null_rate) AS null_rates",
            f"""map_from_entries(transform(filter(fields, f -> {is_date}),
              f -> struct(f.field, f.malformed_count))) AS malformed_date_counts""",
            "transform(filter(fields, f -> f.high_null), f -> f.field) AS high_null_fields",
        )
    )


def gate(df: DataFrame, table_verdict: DataFrame) -> DataFrame:
    """All rows if the verdict is valid, none otherwise.

    The verdict enters as a scalar subquery: it is computed once and reaches
    every task as a constant, so the gate adds no join.
    """
    return df.filter(table_verdict.select("is_valid").scalar())


def profile(df: DataFrame) -> DataFrame:
    """Every column: rows, NULLs, share of non-NULL values (NULL if no rows)."""
    stats = [
        F.struct(
            F.lit(name).alias("column_name"), F.col(f"nulls_{i}").alias("null_count")
        )
        for i, name in enumerate(df.columns)
    ]
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(f"`{n}`").isNull()).alias(f"nulls_{i}") for i, n in enumerate(df.columns)],
    )
    rows = F.col("total_rows")
    return counted.select(rows, F.inline(F.array(*stats))).select(
        "column_name",
        "total_rows",
        "null_count",
        F.try_divide(rows - F.col("null_count"), rows).alias("non_null_coverage"),
    )


def read_verdict(
    df: DataFrame,
    formats: Sequence[str] = fixed.TIMESTAMP_FORMATS,
    renames: dict[str, str] | None = None,
    counted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Aliases and verdict together: (records with canonical names, verdict).

    ``renames`` are aliases that the caller has resolved before; ``counted`` are the
    verdict's counts if they are known.
    """
    found = alias_map(df.columns)
    records = df.withColumnsRenamed(found)
    return records, verdict(records, {**(renames or {}), **found}, formats, counted)
