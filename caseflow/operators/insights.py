"""KPI rows -> insight sentences and signals, one row in, one row out.

A KPI frame may hold one row for the whole table or one per segment. All rules
are SQL expressions over the row and its bounded lists; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from caseflow import fixed_values as fixed
from caseflow.functions.scores import percent_text
from caseflow.functions.texts import filled, quoted

_NO_NAMES = "CAST(array() AS array<string>)"


def _number(df: DataFrame, name: str, default: str = "0.0D") -> str:
    return f"coalesce(double({name}), {default})" if name in df.columns else f"double({default})"


def _figures(df: DataFrame) -> list[str]:
    """What the rules read, under fixed names, with defaults filled in."""
    compliance = _number(df, "sla_compliance_rate", _number(df, "sla_rate"))
    band = "ses_band" if "ses_band" in df.columns else "NULL"
    total = "total_requests" if "total_requests" in df.columns else "NULL"
    return [
        f"{compliance} AS _compliance",
        f"{_number(df, 'sla_breach_rate', f'1 - {compliance}')} AS _breach",
        f"{_number(df, 'backlog_ratio')} AS _backlog",
        f"{_number(df, 'avg_resolution_time')} AS _avg_days",
        f"{_number(df, 'p90_resolution_time')} AS _p90_days",
        f"coalesce({band}, 'unknown') AS _band",
        f"coalesce(bigint({total}), 0L) AS _total",
    ]


def _priority_types(df: DataFrame) -> str:
    if "complaint_type_impact_top" not in df.columns:
        return _NO_NAMES
    return f"""coalesce(
      transform(slice(complaint_type_impact_top, 1, {fixed.PRIORITY_TYPES}),
                t -> coalesce(t.complaint_type, '{fixed.UNKNOWN_LABEL}')),
      {_NO_NAMES})"""


def _slow_boroughs(df: DataFrame) -> str:
    """Boroughs of some size that are clearly slower than the whole, slowest first.

    The list position keeps the given order among equal averages.
    """
    if "borough_stats" not in df.columns:
        return _NO_NAMES
    return f"""coalesce(
      transform(
        slice(
          array_sort(filter(
            transform(borough_stats, (b, i) -> named_struct(
              'order', -coalesce(double(b.avg_resolution_time), 0.0D), 'position', i,
              'total', coalesce(b.total_requests, 0L),
              'name', coalesce(b.borough, '{fixed.UNKNOWN_LABEL}'))),
            b -> _avg_days > 0
              AND b.total >= greatest({fixed.SLOW_MIN_ROWS}L, bigint(_total * {fixed.SLOW_MIN_SHARE}D))
              AND -b.order > _avg_days * {fixed.SLOW_FACTOR}D)),
          1, {fixed.PRIORITY_BOROUGHS}),
        b -> b.name),
      {_NO_NAMES})"""


# (rule, condition, sentence)
_RULES = (
    (
        "sla_below_target",
        f"_compliance < {fixed.SLA_TARGET}D",
        filled(
            fixed.SLA_SENTENCE,
            compliance=percent_text("_compliance"),
            breach=percent_text("_breach"),
        ),
    ),
    (
        "backlog_elevated",
        f"_backlog > {fixed.BACKLOG_LIMIT}D",
        filled(fixed.BACKLOG_SENTENCE, backlog=percent_text("_backlog")),
    ),
    (
        "long_tail",
        f"_avg_days > {fixed.AVG_DAYS_LIMIT} OR _p90_days > {fixed.P90_DAYS_LIMIT}",
        quoted(fixed.LONG_TAIL_SENTENCE),
    ),
    (
        "priority_types",
        "size(_types) > 0",
        filled(fixed.TYPES_SENTENCE, names="array_join(_types, ', ')"),
    ),
    (
        "slow_boroughs",
        "size(_slow) > 0",
        filled(fixed.BOROUGHS_SENTENCE, names="array_join(_slow, ', ')"),
    ),
    (
        "ses_alert",
        f"_band IN ({', '.join(quoted(b) for b in fixed.ALERT_BANDS)})",
        filled(fixed.BAND_SENTENCE, band="_band"),
    ),
)


def derive_insights(kpis: DataFrame) -> DataFrame:
    """Adds ``insights`` (array of rule and sentence, in rule order) and ``signals``."""
    fired = ", ".join(
        f"CASE WHEN {condition} THEN named_struct('rule', '{rule}', 'text', {sentence}) END"
        for rule, condition, sentence in _RULES
    )
    return (
        kpis.selectExpr("*", *_figures(kpis))
        .selectExpr(
            "*", f"{_priority_types(kpis)} AS _types", f"{_slow_boroughs(kpis)} AS _slow"
        )
        .selectExpr("*", f"array_compact(array({fired})) AS _fired")
        .selectExpr(
            *[f"`{c}`" for c in kpis.columns],
            f"""CASE WHEN size(_fired) > 0 THEN _fired
                ELSE array(named_struct('rule', 'stable', 'text', {quoted(fixed.STABLE_SENTENCE)}))
                END AS insights""",
            "named_struct('priority_complaint_types', _types, 'priority_boroughs', _slow) AS signals",
        )
    )


def insight_rows(insights: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sentence, numbered from 0 within its KPI row."""
    return insights.selectExpr(
        *keys, "posexplode(insights) AS (insight_index, _insight)"
    ).selectExpr(*keys, "insight_index", "_insight.rule AS rule", "_insight.text AS insight")
