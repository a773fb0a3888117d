"""The registered queries as plain SQL over the same tables.

Written apart from the DataFrame code: other expressions, one statement each. Only the
texts of sentences and actions are taken from the fixed values.
"""

from __future__ import annotations

from caseflow import fixed_values as fixed

AS_OF = "DATE '2001-08-02'"

_TICKETS = """
tickets AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS k, l.l_partkey, l.l_suppkey,
         o.o_orderdate AS created,
         o.o_orderdate + to_days(30 * CAST(o.o_orderpriority[1] AS INTEGER)) AS due,
         CASE WHEN l.l_linestatus = 'F' THEN l.l_shipdate END AS closed,
         c.c_mktsegment AS agency, p.p_brand AS brand, r.r_name AS borough,
         o.o_orderstatus AS status
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
)"""

_TYPED = _TICKETS + """,
typed AS (
  SELECT k AS unique_key, created AS created_ts, due AS due_ts, closed AS closed_ts,
         agency, brand AS complaint_type, borough, status
  FROM tickets
)"""

_ISO = _TICKETS + """,
iso AS (
  SELECT CAST(k AS VARCHAR) AS unique_key,
         strftime(created, '%Y-%m-%dT%H:%M:%S') AS created_date,
         strftime(due, '%Y-%m-%dT%H:%M:%S') AS due_date,
         strftime(closed, '%Y-%m-%dT%H:%M:%S') AS closed_date,
         agency, brand AS complaint_type, borough, status
  FROM tickets
)"""


def _untidy(moment: str, k: str) -> str:
    return f"""CASE WHEN ({k}) % 20 = 0 THEN NULL
      WHEN ({k}) % 20 = 1 THEN 'bad-date'
      WHEN ({k}) % 3 = 0 THEN strftime({moment}, '%Y-%m-%dT%H:%M:%S')
      WHEN ({k}) % 3 = 1 THEN strftime({moment}, '%Y-%m-%d %H:%M:%S')
      ELSE strftime({moment}, '%Y-%m-%d') END"""


_RAW = _TICKETS + f""",
raw AS (
  SELECT CAST(k AS VARCHAR) AS unique_key,
    {_untidy("created", "l_partkey")} AS created_date,
    {_untidy("due", "l_suppkey")} AS due_date,
    CASE WHEN closed IS NOT NULL THEN {_untidy("closed", "l_partkey + l_suppkey")} END AS closed_date,
    agency, CASE WHEN l_partkey % 50 <> 0 THEN brand END AS complaint_type, borough, status
  FROM tickets
)"""

_CLEAN = _RAW + """,
cleaned AS (
  SELECT unique_key, created_date, due_date, closed_date, agency, complaint_type, borough, status
  FROM raw WHERE created_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY created_date NULLS LAST,
    due_date NULLS LAST, closed_date NULLS LAST, agency NULLS LAST, complaint_type NULLS LAST,
    borough NULLS LAST, status NULLS LAST) = 1
)"""


def _read(name: str) -> str:
    return (
        f"try_strptime({name}_date, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d'])"
        f" AS {name}_ts"
    )


_PARSED = ", ".join(_read(n) for n in ("created", "due", "closed"))

_CLEAN_TYPED = _CLEAN + f""",
typed AS (SELECT *, {_PARSED} FROM cleaned)"""

_DAYS = "CAST(date_diff('day', CAST(created_ts AS DATE), CAST(closed_ts AS DATE)) AS INTEGER)"
_BREACH = """CASE WHEN created_ts IS NULL OR due_ts IS NULL OR closed_ts IS NULL THEN NULL
    WHEN due_ts < created_ts OR closed_ts < created_ts THEN NULL
    WHEN closed_ts > due_ts THEN 1 ELSE 0 END"""

_ROWS = f""",
rows_ AS (
  SELECT unique_key, {{segments}}
    CASE WHEN {_DAYS} IS NULL THEN NULL WHEN {_DAYS} < 0 THEN 0 ELSE {_DAYS} END AS days,
    {_BREACH} AS breach,
    CASE WHEN closed_ts IS NULL THEN 1 ELSE 0 END AS is_open,
    CASE WHEN closed_ts IS NOT NULL THEN 1 ELSE 0 END AS is_closed,
    created_ts, CAST(created_ts AS DATE) AS created_day,
    CAST(date_diff('day', CAST(created_ts AS DATE), {AS_OF}) AS INTEGER) AS age
  FROM typed
),
aged AS (
  SELECT *, CASE WHEN is_open = 0 THEN NULL WHEN age IS NULL THEN 'unknown' WHEN age <= 7 THEN '0-7d'
    WHEN age <= 30 THEN '8-30d' WHEN age <= 90 THEN '31-90d' ELSE '90d+' END AS age_bucket
  FROM rows_
)"""

_LABELS = "".join(
    f"coalesce({s}, 'Unknown') AS {s}, " for s in ("agency", "complaint_type", "borough", "status")
)
_TYPED_ROWS = _TYPED + _ROWS.format(segments=_LABELS)
_CLEAN_ROWS = _CLEAN_TYPED + _ROWS.format(segments=_LABELS)

# figures of any group, before rounding
_FIGURES = """CAST(count(*) AS BIGINT) AS total_requests,
    CAST(coalesce(sum(is_open), 0) AS BIGINT) AS open_requests,
    CAST(coalesce(sum(is_closed), 0) AS BIGINT) AS closed_requests,
    coalesce(sum(is_open) / nullif(count(*), 0), 0.0) AS open_rate,
    coalesce(sum(is_closed) / nullif(count(*), 0), 0.0) AS closed_rate,
    coalesce(avg(days), 0.0) AS avg_resolution_time,
    CAST(coalesce(quantile_disc(days, 0.5), 0) AS DOUBLE) AS median_resolution_time,
    CAST(coalesce(quantile_disc(days, 0.9), 0) AS DOUBLE) AS p90_resolution_time,
    CAST(coalesce(sum(breach), 0) AS BIGINT) AS sla_breach_count,
    CAST(count(breach) AS BIGINT) AS sla_observed_count,
    coalesce(avg(breach), 0.0) AS sla_breach_rate,
    1.0 - coalesce(avg(breach), 0.0) AS sla_compliance_rate,
    coalesce(avg(CASE WHEN is_open = 1 THEN age END), 0.0) AS avg_age_days"""

_SCORE = "(1 - open_rate) * 0.3 + sla_compliance_rate * 0.4 + (1 / (1 + avg_resolution_time)) * 0.3"
_SES = f"""CAST({_SCORE} AS DOUBLE) AS ses_score,
    CASE WHEN {_SCORE} >= 0.75 THEN 'healthy' WHEN {_SCORE} >= 0.60 THEN 'watch'
         WHEN {_SCORE} >= 0.45 THEN 'needs_attention' ELSE 'critical' END AS ses_band"""

_DOUBLES = {
    "open_rate", "closed_rate", "backlog_ratio", "avg_resolution_time", "median_resolution_time",
    "p90_resolution_time", "sla_breach_rate", "sla_compliance_rate", "sla_rate", "ses_score",
    "avg_age_days", "volume_share", "impact_score",
}


def _show(columns: str) -> str:
    shown = []
    for c in columns.split():
        if c in _DOUBLES:
            shown.append(f"round({c}, 6) AS {c}")
        elif c == "created_day":
            shown.append("strftime(created_day, '%Y-%m-%d') AS created_day")
        else:
            shown.append(c)
    return ", ".join(shown)


def _grouped(keys: str, where: str = "TRUE") -> str:
    lead = f"{keys}, " if keys else ""
    by = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {lead}{_FIGURES} FROM aged WHERE {where}{by}"


def _place(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS place"


def _with_ses(inner: str) -> str:
    return f"SELECT *, open_rate AS backlog_ratio, sla_compliance_rate AS sla_rate, {_SES} FROM ({inner})"


_SUMMARY = (
    "total_requests open_requests closed_requests open_rate closed_rate backlog_ratio "
    "avg_resolution_time median_resolution_time p90_resolution_time sla_breach_count "
    "sla_observed_count sla_breach_rate sla_compliance_rate sla_rate ses_score ses_band"
)
_SEGMENT = (
    "total_requests open_requests closed_requests avg_resolution_time median_resolution_time "
    "sla_breach_rate sla_compliance_rate"
)
_TYPE = f"complaint_type {_SEGMENT} volume_share impact_score"

_IMPACT = """volume_share * sla_breach_rate * greatest(avg_resolution_time, 0.0) AS impact_score"""


def _types(source: str) -> str:
    """CTE chain ending in ``types``: the ten largest complaint types."""
    return f"""{source},
by_type AS (
  SELECT *, total_requests / (SELECT count(*) FROM aged) AS volume_share
  FROM ({_grouped("complaint_type")})
),
types AS (
  SELECT *, {_IMPACT} FROM by_type
  ORDER BY total_requests DESC, complaint_type LIMIT 10
),
impact AS (
  SELECT *, row_number() OVER (ORDER BY impact_score DESC, total_requests DESC, complaint_type) AS place
  FROM types
)"""


_BUCKET_PLACE = """CASE age_bucket WHEN '0-7d' THEN 1 WHEN '8-30d' THEN 2 WHEN '31-90d' THEN 3
    WHEN '90d+' THEN 4 ELSE 5 END"""

# --- quality -----------------------------------------------------------------------

_FIELDS = ("unique_key", "created_date", "due_date", "closed_date", "agency", "complaint_type", "borough")
_DATES = ("created_date", "due_date", "closed_date")


def _quality(source: str, absent: tuple[str, ...] = ()) -> str:
    """CTE ``q``: one row per required field."""
    parts = []
    for i, f in enumerate(_FIELDS):
        if absent:
            nulls = bad = "0"
        else:
            nulls = f"count(*) - count({f})"
            bad = (
                f"count(*) FILTER ({f} IS NOT NULL AND try_strptime({f}, ['%Y-%m-%dT%H:%M:%S',"
                f" '%Y-%m-%d %H:%M:%S', '%Y-%m-%d']) IS NULL)"
                if f in _DATES
                else "0"
            )
        parts.append(
            f"SELECT {i} AS place, '{f}' AS field, CAST(count(*) AS BIGINT) AS row_count,"
            f" CAST({nulls} AS BIGINT) AS null_count, CAST({bad} AS BIGINT) AS malformed_count"
            f" FROM {source}"
        )
    checked = "FALSE" if absent else "TRUE"
    return f"""q AS (
  SELECT *, null_count / row_count AS null_rate,
    {checked} AND null_count = row_count AS all_null,
    {checked} AND null_count < row_count AND null_count / row_count >= 0.5 AS high_null
  FROM ({" UNION ALL ".join(parts)})
)"""


def _verdict(base: str, source: str, absent: tuple[str, ...] = (), renames: tuple = ()) -> str:
    accepted = [f"Accepted alias '{a}' was normalized to '{c}'." for a, c in renames]
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in accepted)
    missing = [f for f in _FIELDS if f in absent]
    first = (
        [f"'Missing required fields: {', '.join(missing)}'"] if missing else []
    )
    return f"""WITH {base}, {_quality(source, absent)},
messages AS (
  SELECT max(row_count) AS row_count,
    list_concat([{", ".join(first)}]::VARCHAR[],
      coalesce(list('All records have null ' || field || '.' ORDER BY place) FILTER (all_null), []),
      coalesce(list('Field ''' || field || ''' contains ' || malformed_count
        || ' malformed timestamp value(s).' ORDER BY place) FILTER (malformed_count > 0), [])) AS errors,
    list_concat([{quoted}]::VARCHAR[],
      coalesce(list('High null rate detected in ''' || field || ''' ('
        || printf('%.1f%%', 100 * null_rate) || ').' ORDER BY place) FILTER (high_null), [])) AS warnings,
    coalesce(string_agg(field, ' | ' ORDER BY place) FILTER (high_null), '') AS high_null_fields
  FROM q
)
SELECT len(errors) = 0 AS is_valid, row_count, array_to_string(errors, ' | ') AS errors,
  array_to_string(warnings, ' | ') AS warnings, '{" | ".join(missing)}' AS missing_fields,
  high_null_fields, '{" | ".join(f"{a}={c}" for a, c in renames)}' AS alias_resolution
FROM messages"""


_RENAMES = (
    ("uniqueKey", "unique_key"), ("created_ts", "created_date"), ("due_dt", "due_date"),
    ("closedDate", "closed_date"), ("agency_name", "agency"),
    ("complaint_category", "complaint_type"), ("borough_name", "borough"),
)

_PROFILE_FIELDS = (*_FIELDS, "status")

# --- insights and actions --------------------------------------------------------------


def _filled(text: str, **values: str) -> str:
    """A text with SQL expressions in its braces, as one SQL expression."""
    sql = "'" + text.replace("'", "''") + "'"
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


def _pct(x: str) -> str:
    return f"printf('%.1f%%', 100 * {x})"


def _insights(base: str, kpis: str, keys: str = "", types: str = "NULL", slow: str = "NULL") -> str:
    """CTE ``insights``: one row per sentence of each row of ``kpis``."""
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    rules = [
        ("sla_below_target", "sla_compliance_rate < 0.9",
         _filled(fixed.SLA_SENTENCE, compliance=_pct("sla_compliance_rate"), breach=_pct("sla_breach_rate"))),
        ("backlog_elevated", "backlog_ratio > 0.2", _filled(fixed.BACKLOG_SENTENCE, backlog=_pct("backlog_ratio"))),
        ("long_tail", "(avg_resolution_time > 3 OR p90_resolution_time > 7)", _filled(fixed.LONG_TAIL_SENTENCE)),
        ("priority_types", "types_ IS NOT NULL", _filled(fixed.TYPES_SENTENCE, names="types_")),
        ("slow_boroughs", "slow_ IS NOT NULL", _filled(fixed.BOROUGHS_SENTENCE, names="slow_")),
        ("ses_alert", "ses_band IN ('needs_attention', 'critical')", _filled(fixed.BAND_SENTENCE, band="ses_band")),
    ]
    fired = " UNION ALL ".join(
        f"SELECT {lead}{i} AS place, '{rule}' AS rule, {text} AS insight FROM input WHERE {when}"
        for i, (rule, when, text) in enumerate(rules)
    )
    quiet = (
        f"SELECT {lead}9 AS place, 'stable' AS rule, {_filled(fixed.STABLE_SENTENCE)} AS insight"
        " FROM input WHERE NOT ("
        + " OR ".join(f"coalesce({when}, FALSE)" for _, when, _ in rules)
        + ")"
    )
    return f"""{base},
kpi AS ({_with_ses(kpis)}),
input AS (SELECT *, CAST({types} AS VARCHAR) AS types_, CAST({slow} AS VARCHAR) AS slow_ FROM kpi),
sentences AS ({fired} UNION ALL {quiet}),
insights AS (
  SELECT {lead}CAST(row_number() OVER ({part}ORDER BY place) - 1 AS INTEGER) AS insight_index, rule, insight
  FROM sentences
)"""



def _slow(source: str) -> str:
    """CTE chain ending in ``slow``: the slow ones of the ten largest boroughs."""
    return f"""{source},
listed AS ({_grouped("borough")} ORDER BY total_requests DESC, borough LIMIT 10),
slow AS (
  SELECT borough, row_number() OVER (ORDER BY avg_resolution_time DESC, total_requests DESC, borough) AS place
  FROM listed
  WHERE total_requests >= greatest(100, CAST(floor((SELECT count(*) FROM aged) * 0.005) AS BIGINT))
    AND avg_resolution_time > 1.15 * (SELECT avg(days) FROM aged)
)"""


_SLOW_NAMES = "(SELECT string_agg(borough, ', ' ORDER BY place) FROM slow WHERE place <= 3)"
_FIRST_TYPES = "(SELECT string_agg(complaint_type, ', ' ORDER BY place) FROM impact WHERE place <= 5)"
_GLOBAL = _insights(
    _slow(_types(_TYPED_ROWS)), _grouped(""), types=_FIRST_TYPES, slow=_SLOW_NAMES
)
_BY_AGENCY = _insights(_TYPED_ROWS, _grouped("agency"), "agency")
_BY_DAY = _insights(_TYPED_ROWS, _grouped("created_day"), "created_day")

_ACTION_TABLE = "action_table(category, id, priority, recommendation) AS (VALUES " + ", ".join(
    f"('{category}', '{key}', {priority}, {_filled(text)})"
    for category, (key, priority, text) in {**fixed.ACTIONS, **fixed.FALLBACK_ACTIONS}.items()
) + ")"


def _actions(insights: str, keys: str = "", signals: str = "") -> str:
    """CTE ``evidence``: one row per match, then signals, then the fallback."""
    lead = f"{keys}, " if keys else ""
    same = f"e.{keys} = i.{keys}" if keys else "TRUE"
    low = "lower(insight)"
    matches = (
        ("service_recovery", f"{low} LIKE '%critical%' OR {low} LIKE '%needs\\_attention%' ESCAPE '\\'",
         f"CASE WHEN {low} LIKE '%critical%' THEN 100 ELSE 90 END"),
        ("sla_management", f"{low} LIKE '%sla compliance%' OR {low} LIKE '%breach rate%'",
         f"CASE WHEN {low} LIKE '%breach rate%' THEN 85 ELSE 75 END"),
        ("backlog_management", f"{low} LIKE '%backlog%'", "80"),
        ("resolution_flow", f"{low} LIKE '%resolution time%' OR {low} LIKE '%long-tail%'", "70"),
        ("complaint_type_redesign", f"{low} LIKE '%impact complaint categories%'", "65"),
        ("borough_operations", f"{low} LIKE '%boroughs%' AND {low} LIKE '%slower%'", "65"),
    )
    found = " UNION ALL ".join(
        f"SELECT {lead}'{category}' AS category, 'insight' AS source, insight AS trigger,"
        f" {strength} AS strength, insight_index AS seen, insight_index,"
        f" NULL AS signal_key, NULL AS signal_value FROM insights WHERE {when}"
        for category, when, strength in matches
    )
    return f"""{insights}, {_ACTION_TABLE},
matched AS ({found}{signals}),
evidence AS (
  SELECT * FROM matched
  UNION ALL
  SELECT {lead}c.category, 'fallback', 'no actionable insights were generated', 1, 0, NULL, NULL, NULL
  FROM (SELECT DISTINCT {keys or "1 AS one"} FROM insights) i, (VALUES ('monitoring'), ('alerting')) c(category)
  WHERE NOT EXISTS (SELECT 1 FROM matched e WHERE {same})
)"""


def _action_rows(ctes: str, keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    first = "ORDER BY strength DESC, trigger, seen"
    return f"""WITH {ctes}
SELECT {_show(keys) + ", " if keys else ""}id, a.category, priority, recommendation,
  CAST(n AS INTEGER) AS evidence_count, strongest_source, strongest_trigger,
  CAST(strongest_strength AS INTEGER) AS strongest_strength
FROM (
  SELECT {lead}category, count(*) AS n, first(source {first}) AS strongest_source,
    first(trigger {first}) AS strongest_trigger, first(strength {first}) AS strongest_strength
  FROM evidence GROUP BY {lead}category
) e JOIN action_table a ON e.category = a.category"""


_SIGNALS_GLOBAL = "".join(
    f""" UNION ALL SELECT '{category}', 'signal', '{key}', 95, 99, NULL, '{key}',
  replace({names}, ', ', ' | ') WHERE {names} IS NOT NULL"""
    for category, key, names in (
        ("complaint_type_redesign", "priority_complaint_types", _FIRST_TYPES),
        ("borough_operations", "priority_boroughs", _SLOW_NAMES),
    )
)

_DISTRICTS = _TYPED.replace("borough, status\n  FROM tickets", "'DISTRICT ' || year(closed) AS borough, status\n  FROM tickets")

_BY_DISTRICT = _insights(
    _slow(_types(_DISTRICTS + _ROWS.format(segments=_LABELS))), _grouped(""), types=_FIRST_TYPES, slow=_SLOW_NAMES
)

# --- cube ---------------------------------------------------------------------------------

_CUBE_KEYS = ("created_day", "agency", "complaint_type", "borough", "age_bucket", "status")


def _cube_scope(scope: str, keys: tuple[str, ...], order: str, limit: int, where: str = "TRUE") -> str:
    columns = ", ".join(
        k if k in keys else f"CAST(NULL AS {'DATE' if k == 'created_day' else 'VARCHAR'}) AS {k}"
        for k in _CUBE_KEYS
    )
    return f"""SELECT * FROM (SELECT '{scope}' AS scope,
  CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS report_rank, {columns}, * EXCLUDE ({", ".join(keys) or "dummy"})
  FROM (SELECT {"" if keys else "1 AS dummy, "}* FROM ({_with_ses(_grouped(", ".join(keys), where))}))) WHERE report_rank <= {limit}"""


_QUANTILE_SCOPES = "('all', 'complaint_type', 'agency', 'agency_complaint_type')"
_NO_QUANTILES = " REPLACE (" + ", ".join(
    f"CASE WHEN scope IN {_QUANTILE_SCOPES} THEN {q}_resolution_time END AS {q}_resolution_time"
    for q in ("median", "p90")
) + ")"

_CUBE = " UNION ALL ".join(
    (
        _cube_scope("all", (), "total_requests", 1),
        _cube_scope("created_day", ("created_day",), "created_day DESC", 30, "created_day IS NOT NULL"),
        _cube_scope("complaint_type", ("complaint_type",), "total_requests DESC, complaint_type", 10),
        _cube_scope("agency", ("agency",), "total_requests DESC, agency", 10),
        _cube_scope("borough", ("borough",), "total_requests DESC, borough", 10),
        _cube_scope("age_bucket", ("age_bucket",), _BUCKET_PLACE, 5, "is_open = 1"),
        _cube_scope("agency_complaint_type", ("agency", "complaint_type"),
                    "total_requests DESC, agency, complaint_type", 25),
        _cube_scope("status", ("status",), "total_requests DESC, status", 10),
    )
)
_CUBE_COLUMNS = (
    "scope report_rank created_day agency complaint_type borough age_bucket status total_requests "
    "open_requests closed_requests avg_resolution_time median_resolution_time p90_resolution_time "
    "sla_breach_count sla_observed_count sla_breach_rate sla_compliance_rate open_rate avg_age_days "
    "ses_score ses_band"
)


def _listed(text: str, scope: str, order: str = "report_rank") -> str:
    return f"coalesce((SELECT string_agg({text}, ' | ' ORDER BY {order}) FROM cube WHERE scope = '{scope}'), '')"


def _fields(columns: str) -> str:
    """Columns of a row as one text, doubles with nine places."""
    return " || ':' || ".join(f"printf('%.9f', {c})" if c in _DOUBLES else f"CAST({c} AS VARCHAR)" for c in columns.split())


_FEATURES = f"{_DAYS} AS resolution_time_days, CAST(closed_ts IS NOT NULL AS INTEGER) AS resolution_completed, {_BREACH} AS sla_breach"


def _text(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


_EVENT = "event_id, ts, user_id, event_type, value"
_FAILED = ", ".join(
    f"CAST({n}_date IS NOT NULL AND {n}_ts IS NULL AS INTEGER) AS {n}_ts_parse_failed"
    for n in ("created", "due", "closed")
)

ORACLES: dict[str, str] = {
    # --- scans
    "window_scan": f"""SELECT {_EVENT} FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'
ORDER BY ts, event_id LIMIT 5000""",
    "window_scan_default": f"""SELECT {_EVENT} FROM events
WHERE ts BETWEEN TIMESTAMP '2023-12-26 00:00:00' AND TIMESTAMP '2024-01-25 23:59:59'
ORDER BY ts, event_id""",
    "window_scan_fallback": f"SELECT {_EVENT} FROM events ORDER BY ts DESC, event_id LIMIT 5000",
    "window_scan_hit": f"""SELECT {_EVENT} FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'
ORDER BY ts, event_id LIMIT 5000""",
    "first_tenth": f"""SELECT {_EVENT} FROM events
QUALIFY row_number() OVER (ORDER BY date_trunc('hour', ts), user_id, event_type, event_id)
  <= (SELECT count(*) // 10 FROM events)""",
    "window_scan_text": f"""WITH {_RAW}, parsed AS (SELECT *, {_PARSED} FROM raw)
SELECT unique_key, created_date, due_date, closed_date, agency, complaint_type, borough, status FROM parsed
WHERE created_ts >= DATE '1996-01-01' AND created_ts <= TIMESTAMP '1996-12-31 23:59:59'""",
    "window_normalise": """WITH bounds AS (
  SELECT event_id, CAST(ts AS DATE) AS a,
    CAST(CAST(ts AS DATE) + CAST(user_id % 41 - 20 AS INTEGER) AS DATE) AS b FROM events
), ordered AS (
  SELECT event_id, least(a, b) AS low, least(greatest(a, b), DATE '2024-01-20') AS high FROM bounds
)
SELECT event_id, strftime(least(low, high), '%Y-%m-%d') AS window_start,
  strftime(high, '%Y-%m-%d') AS window_end FROM ordered""",
    # --- schema and quality
    "alias_normalise": f"WITH {_RAW} SELECT * FROM raw",
    "quality_counts": f"""WITH {_RAW}, {_quality("raw")}
SELECT field, row_count, null_count, round(null_rate, 6) AS null_rate, malformed_count, all_null, high_null
FROM q""",
    "quality_verdict": _verdict(_RAW, "raw", renames=_RENAMES),
    "quality_verdict_valid": _verdict(_ISO, "iso"),
    "quality_verdict_formats": _verdict(_ISO, "iso"),
    "quality_verdict_missing": _verdict(_RAW, "raw", absent=("complaint_type", "borough")),
    "quality_verdict_all_null": _verdict(
        _ISO + ",\nno_due AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS due_date) FROM iso)", "no_due"
    ),
    "quality_gate_pass": f"""WITH {_ISO} SELECT TRUE AS is_valid, CAST(count(*) AS BIGINT) AS rows_in,
  CAST(count(*) AS BIGINT) AS rows_passed FROM iso""",
    "quality_gate_fail": f"""WITH {_RAW}, {_quality("raw")}
SELECT bool_and(malformed_count = 0 AND NOT all_null) AS is_valid, max(row_count) AS rows_in,
  CAST(CASE WHEN bool_and(malformed_count = 0 AND NOT all_null) THEN max(row_count) ELSE 0 END AS BIGINT)
    AS rows_passed FROM q""",
    "profile_columns": f"WITH {_RAW} " + " UNION ALL ".join(
        f"SELECT '{f}' AS column_name, CAST(count(*) AS BIGINT) AS total_rows,"
        f" CAST(count(*) - count({f}) AS BIGINT) AS null_count,"
        f" round(count({f}) / count(*), 6) AS non_null_coverage FROM raw"
        for f in _PROFILE_FIELDS
    ),
    # --- rows
    "clean_dedup": f"WITH {_CLEAN} SELECT * FROM cleaned",
    "clean_dedup_narrow": f"WITH {_CLEAN} SELECT * FROM cleaned",
    "parse_timestamps": f"""WITH {_RAW}, parsed AS (SELECT *, {_PARSED} FROM raw)
SELECT unique_key, {_text("created_ts")}, {_text("due_ts")}, {_text("closed_ts")}, {_FAILED} FROM parsed""",
    "parse_typed": f"""WITH {_TYPED}
SELECT unique_key, strftime(created_ts + INTERVAL 500001 MICROSECOND, '%Y-%m-%d %H:%M:%S.%f') AS created_ts,
  strftime(due_ts, '%Y-%m-%d 00:00:00.000000') AS due_ts, strftime(closed_ts, '%Y-%m-%d %H:%M:%S.%f') AS closed_ts,
  0 AS created_ts_parse_failed, 0 AS due_ts_parse_failed, 0 AS closed_ts_parse_failed FROM typed""",
    "sla_features": f"WITH {_CLEAN_TYPED} SELECT unique_key, {_FEATURES} FROM typed",
    "resolution_features": f"WITH {_TYPED} SELECT unique_key, {_FEATURES} FROM typed",
    "kpi_measures": f"""WITH {_CLEAN_ROWS}
SELECT unique_key, complaint_type, days AS resolution_time_days, breach AS sla_breach_int, is_open,
  is_closed, strftime(created_day, '%Y-%m-%d') AS created_day, age AS age_days, age_bucket FROM aged""",
    "backfill_columns": f"""WITH {_CLEAN_TYPED}
SELECT unique_key, {_text("created_ts")}, CAST(NULL AS VARCHAR) AS closed_ts,
  CAST(NULL AS INTEGER) AS resolution_time_days, CAST(NULL AS INTEGER) AS sla_breach FROM typed""",
    "backfill_from_text": f"""WITH {_CLEAN_TYPED}
SELECT unique_key, {_text("created_ts")}, {_text("closed_ts")}, {_DAYS} AS resolution_time_days,
  CAST(NULL AS INTEGER) AS sla_breach FROM typed""",
    # --- KPIs
    "kpi_summary": f"WITH {_TYPED_ROWS} SELECT {_show(_SUMMARY)} FROM ({_with_ses(_grouped(''))})",
    "kpi_summary_clean": f"WITH {_CLEAN_ROWS} SELECT {_show(_SUMMARY)} FROM ({_with_ses(_grouped(''))})",
    "ses_by_agency": f"""WITH {_TYPED_ROWS} SELECT agency, {_show(_SUMMARY)}
FROM ({_with_ses(_grouped("agency"))})""",
    "kpi_daily_trend": f"""WITH {_TYPED_ROWS} SELECT strftime(created_day, '%Y-%m-%d') AS created_day,
  total_requests AS volume, {_show("open_requests closed_requests avg_resolution_time sla_breach_rate")}, {_place("created_day")}
FROM ({_grouped("created_day", "created_day IS NOT NULL")} ORDER BY created_day DESC LIMIT 30)""",
    "kpi_top_types": f"WITH {_types(_CLEAN_ROWS)} SELECT {_show(_TYPE)}, {_place("total_requests DESC, complaint_type")} FROM types",
    "kpi_type_impact": f"WITH {_types(_CLEAN_ROWS)} SELECT {_show(_TYPE)}, CAST(place AS INTEGER) AS place FROM impact WHERE place <= 10",
    "kpi_top_agencies": f"""WITH {_TYPED_ROWS} SELECT {_show("agency " + _SEGMENT)}, {_place("total_requests DESC, agency")}
FROM ({_grouped("agency")}) ORDER BY total_requests DESC, agency LIMIT 10""",
    "kpi_boroughs": f"""WITH {_TYPED_ROWS} SELECT {_show("borough total_requests open_requests "
    "closed_requests open_rate avg_resolution_time sla_breach_rate sla_compliance_rate")},
  {_place("total_requests DESC, borough")}
FROM ({_grouped("borough")}) ORDER BY total_requests DESC, borough LIMIT 10""",
    "kpi_backlog_ageing": f"""WITH {_CLEAN_ROWS} SELECT age_bucket, CAST(count(*) AS BIGINT) AS open_count,
  round(coalesce(avg(age), 0.0), 6) AS avg_age_days, {_place(_BUCKET_PLACE)} FROM aged WHERE is_open = 1 GROUP BY age_bucket""",
    "kpi_agency_type": f"""WITH {_TYPED_ROWS} SELECT {_show("agency complaint_type " + _SEGMENT + " closed_rate")},
  {_place("total_requests DESC, agency, complaint_type")}
FROM ({_grouped("agency, complaint_type")}) ORDER BY total_requests DESC, agency, complaint_type LIMIT 25""",
    "kpi_status": f"""WITH {_TYPED_ROWS} SELECT status, total_requests, {_place("total_requests DESC, status")} FROM ({_grouped("status")})
ORDER BY total_requests DESC, status LIMIT 10""",
    "kpi_cube": f"""WITH {_TYPED_ROWS}, cube AS ({_CUBE})
SELECT {_show(_CUBE_COLUMNS)} FROM (SELECT *{_NO_QUANTILES} FROM cube)""",
    "median_approx": f"""WITH {_TYPED_ROWS} SELECT agency, CAST(count(*) AS BIGINT) AS total_requests,
  TRUE AS median_in_rank, TRUE AS p90_in_rank FROM aged GROUP BY agency""",
    "kpi_pack": f"""WITH {_types(_CLEAN_ROWS)}, cube AS ({_CUBE})
SELECT {_show(_SUMMARY)},
  {_fields("total_requests open_requests closed_requests open_rate closed_rate")} AS volume,
  {_fields("avg_resolution_time median_resolution_time p90_resolution_time")} AS resolution,
  {_fields("sla_breach_count sla_breach_rate sla_compliance_rate sla_observed_count")} AS sla,
  {_listed(_fields("created_day total_requests open_requests closed_requests avg_resolution_time sla_breach_rate"),
           "created_day", "created_day")} AS time_trends,
  (SELECT string_agg({_fields(_TYPE)}, ' | ' ORDER BY total_requests DESC, complaint_type) FROM types)
    AS top_complaint_types,
  (SELECT string_agg({_fields(_TYPE)}, ' | ' ORDER BY place) FROM impact WHERE place <= 10)
    AS complaint_type_impact_top,
  {_listed(_fields("agency " + _SEGMENT), "agency")} AS top_agencies,
  {_listed(_fields("borough total_requests open_requests closed_requests open_rate avg_resolution_time "
                   "sla_breach_rate sla_compliance_rate"), "borough")} AS borough_stats,
  {_listed(_fields("age_bucket open_requests avg_age_days"), "age_bucket")} AS backlog_ageing,
  {_listed(_fields("agency complaint_type " + _SEGMENT + " closed_rate"), "agency_complaint_type")}
    AS agency_category_performance,
  {_listed(_fields("status total_requests"), "status")} AS status_breakdown
FROM cube WHERE scope = 'all'""",
    # --- insights and actions
    "insights_global": f"WITH {_GLOBAL} SELECT insight_index, rule, insight FROM insights",
    "insights_by_agency": f"WITH {_BY_AGENCY} SELECT agency, insight_index, rule, insight FROM insights",
    "insights_by_day": f"""WITH {_BY_DAY}
SELECT {_show("created_day")}, insight_index, rule, insight FROM insights""",
    "insights_slow_boroughs": f"""WITH {_slow(_types(_DISTRICTS + _ROWS.format(segments=_LABELS)))}
SELECT {_filled(fixed.BOROUGHS_SENTENCE, names=_SLOW_NAMES)} AS insight,
  coalesce(replace({_SLOW_NAMES}, ', ', ' | '), '') AS priority_boroughs,
  replace({_FIRST_TYPES}, ', ', ' | ') AS priority_complaint_types""",
    "actions_global": _action_rows(_actions(_GLOBAL, signals=_SIGNALS_GLOBAL)),
    "action_evidence": f"""WITH {_actions(_GLOBAL, signals=_SIGNALS_GLOBAL)}
SELECT a.id, a.category,
  CAST(row_number() OVER (PARTITION BY a.id ORDER BY strength DESC, trigger, seen) - 1 AS INTEGER) AS evidence_rank,
  source, trigger, CAST(strength AS INTEGER) AS evidence_strength, insight_index, signal_key, signal_value
FROM evidence e JOIN action_table a ON e.category = a.category""",
    "actions_slow_boroughs": _action_rows(_actions(_BY_DISTRICT, signals=_SIGNALS_GLOBAL)),
    "actions_by_agency": _action_rows(_actions(_BY_AGENCY, "agency"), "agency"),
    "actions_by_day": _action_rows(_actions(_BY_DAY, "created_day"), "created_day"),
    # --- reports, helpers, snapshots
    "report_rows": f"""WITH {_TYPED_ROWS}, figures AS (
  SELECT agency, status, list_sort(list(DISTINCT borough)) AS boroughs, min(created_ts) AS first_created,
    max(created_day) AS last_day, count(*) AS n FROM aged GROUP BY agency, status
)
SELECT '{{"agency":"' || agency || '","status":"' || status || '","boroughs":["'
  || array_to_string(boroughs, '","') || '"],"first_created":"' || strftime(first_created, '%Y-%m-%dT%H:%M:%S')
  || '","last_day":"' || strftime(last_day, '%Y-%m-%d') || '","quarter":'
  || CASE WHEN n % 4 = 0 THEN CAST(n // 4 AS VARCHAR) ELSE CAST(n / 4 AS VARCHAR) END
  || ',"nothing":null}}' AS report FROM figures""",
    "distinct_values": f"WITH {_TYPED} SELECT DISTINCT agency FROM typed",
    "group_dict": f"""WITH {_TYPED} SELECT agency, status, CAST(count(unique_key) AS BIGINT) AS requests,
  strftime(max(created_ts), '%Y-%m-%d %H:%M:%S') AS last_created FROM typed GROUP BY agency, status""",
    "group_keys": f"WITH {_TYPED} SELECT DISTINCT agency, status FROM typed",
    "row_count": f"WITH {_RAW} SELECT CAST(count(*) AS BIGINT) AS row_count FROM raw",
    "raw_snapshot": f"WITH {_RAW} SELECT * FROM raw",
    "processed_snapshot": f"""WITH {_CLEAN_TYPED}
SELECT unique_key, created_date, due_date, closed_date, agency, complaint_type, borough, status,
  {_text("created_ts")}, {_text("due_ts")}, {_text("closed_ts")}, {_FAILED}, {_FEATURES} FROM typed""",
}

# kept batches give what their union gives
ORACLES["kpi_pack_kept"] = ORACLES["kpi_pack"]
ORACLES["median_merged"] = ORACLES["median_approx"]
# rules in a frame act like the built-in ones
ORACLES["actions_from_rules"] = ORACLES["actions_global"]
# records in arrays are the records
ORACLES["array_scan"] = ORACLES["raw_snapshot"]
