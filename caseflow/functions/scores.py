"""Rates, scores and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow import fixed_values as fixed


def non_negative(days: Column) -> Column:
    """Negative values become 0; NULL stays NULL, which ``greatest`` would lose."""
    return F.when(days < 0, 0).otherwise(days)


def labelled(value: Column) -> Column:
    return F.coalesce(value, F.lit(fixed.UNKNOWN_LABEL))


def ses_score(backlog: Column, compliance: Column, avg_days: Column) -> Column:
    return (
        (1 - backlog) * fixed.SES_BACKLOG_WEIGHT
        + compliance * fixed.SES_COMPLIANCE_WEIGHT
        + (1 / (1 + avg_days)) * fixed.SES_SPEED_WEIGHT
    )


def ses_band(score: Column) -> Column:
    (lowest, label), *rest = fixed.SES_BANDS
    band = F.when(score >= lowest, label)
    for lowest, label in rest:
        band = band.when(score >= lowest, label)
    return band.otherwise(fixed.LOWEST_BAND)


def percent_text(rate: str) -> str:
    """SQL for a non-negative rate as text with one decimal, as C's ``%.1f`` rounds it.

    The double 100 * rate is rounded by its exact value, ties to even. Spark's
    own rounding works on the shortest decimal text of the double instead, and
    so errs where only that text is a tie. 20 * v is held exactly as the
    unevaluated sum of ``t`` and ``4v - (t - 16v)``: its floor is even below a
    half and odd from a half up.
    """
    return f"""
    transform(array(100 * double({rate})), v ->
      transform(array(v * 16 + v * 4), t ->
        transform(array(v * 4 - (t - v * 16)), rest ->
          transform(array(floor(t) - if(floor(t) = t AND rest < 0, 1, 0)), w ->
            transform(
              array(w div 2 + CASE WHEN w % 2 = 0 THEN 0
                                   WHEN floor(t) = t AND rest = 0 THEN (w div 2) % 2
                                   ELSE 1 END),
              tenths -> concat(string(tenths div 10), '.', string(tenths % 10), '%')
            )[0])[0])[0])[0])[0]"""
