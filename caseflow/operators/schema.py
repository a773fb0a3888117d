"""Field names: aliases and required fields. Decided when the plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from caseflow import fixed_values as fixed


def alias_map(columns: Sequence[str]) -> dict[str, str]:
    """alias found -> canonical name, for canonical names that are absent.

    Names are compared with case, unlike Spark's own column lookup. One column
    serves one canonical name only.
    """
    present = set(columns)
    renames: dict[str, str] = {}
    for canonical, aliases in fixed.ALIASES.items():
        if canonical in present:
            continue
        found = next((a for a in aliases if a in present), None)
        if found is not None:
            renames[found] = canonical
    return renames


def alias_warnings(renames: dict[str, str]) -> list[str]:
    return [
        fixed.ALIAS_MESSAGE.format(alias=alias, canonical=canonical)
        for alias, canonical in renames.items()
    ]


def normalize_aliases(df: DataFrame) -> DataFrame:
    """Canonical names for accepted aliases; columns already canonical stay."""
    return df.withColumnsRenamed(alias_map(df.columns))


def missing_fields(df: DataFrame) -> list[str]:
    return [name for name in fixed.REQUIRED_FIELDS if name not in df.columns]
