"""Values that decide results: names, formats, thresholds, texts.

All of them are fixed values. They are parts of the results' meaning, so they
are stated here once, and the operators take them as defaults.
"""

from __future__ import annotations

# --- record schema -----------------------------------------------------------

REQUIRED_FIELDS = (
    "unique_key",
    "created_date",
    "due_date",
    "closed_date",
    "agency",
    "complaint_type",
    "borough",
)

DATE_FIELDS = ("created_date", "due_date", "closed_date")

# canonical name -> other accepted names, best first
ALIASES = {
    "unique_key": ("Unique Key", "uniqueKey", "complaint_id"),
    "created_date": ("created_dt", "created_ts", "createdDate"),
    "due_date": ("due_dt", "due_ts", "dueDate"),
    "closed_date": ("closed_dt", "closed_ts", "closedDate"),
    "agency": ("agency_name",),
    "complaint_type": ("complaint", "complaint_category"),
    "borough": ("borough_name",),
}

TIMESTAMP_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)

HIGH_NULL_RATE = 0.50
UNKNOWN_LABEL = "Unknown"

# --- messages of the checks ----------------------------------------------------

ALIAS_MESSAGE = "Accepted alias '{alias}' was normalized to '{canonical}'."
EMPTY_MESSAGE = "Input dataset is empty."
MISSING_MESSAGE = "Missing required fields: {fields}"
ALL_NULL_MESSAGE = "All records have null {field}."
HIGH_NULL_MESSAGE = "High null rate detected in '{field}' ({rate})."
MALFORMED_MESSAGE = "Field '{field}' contains {count} malformed timestamp value(s)."

# --- scan limits -------------------------------------------------------------

WINDOW_DAYS = 30

# --- KPI limits and scores ---------------------------------------------------

TOP_N = 10
TREND_POINTS = 30
AGENCY_CATEGORY_LIMIT = 25
IMPACT_LIMIT = 10

# (largest age in days, label); older rows take the last label
AGE_BUCKETS = ((7, "0-7d"), (30, "8-30d"), (90, "31-90d"))
OLDEST_BUCKET = "90d+"
UNKNOWN_BUCKET = "unknown"

# weights of backlog, compliance and speed in the efficiency score
SES_BACKLOG_WEIGHT = 0.3
SES_COMPLIANCE_WEIGHT = 0.4
SES_SPEED_WEIGHT = 0.3

# (lowest score, band); lower scores take the last band
SES_BANDS = ((0.75, "healthy"), (0.60, "watch"), (0.45, "needs_attention"))
LOWEST_BAND = "critical"
ALERT_BANDS = ("needs_attention", "critical")

# --- insight thresholds ------------------------------------------------------

SLA_TARGET = 0.90
BACKLOG_LIMIT = 0.20
AVG_DAYS_LIMIT = 3
P90_DAYS_LIMIT = 7
SLOW_FACTOR = 1.15
SLOW_MIN_ROWS = 100
SLOW_MIN_SHARE = 0.005
PRIORITY_TYPES = 5
PRIORITY_BOROUGHS = 3

# --- insight sentences ---------------------------------------------------------

SLA_SENTENCE = "Overall SLA compliance is {compliance} (breach rate {breach}), below a 90% target."
BACKLOG_SENTENCE = (
    "Backlog is elevated at {backlog} of requests, indicating unresolved workload accumulation."
)
LONG_TAIL_SENTENCE = "Resolution time distribution is stretched, with long-tail delays affecting user experience."
TYPES_SENTENCE = "Highest overall service-impact complaint categories are: {names}."
BOROUGHS_SENTENCE = "Some boroughs have materially slower resolution performance than the system average: {names}."
BAND_SENTENCE = (
    "System efficiency score is in the '{band}' band and requires active operational intervention."
)
STABLE_SENTENCE = "Current performance indicators look stable with no major system-wide anomalies."

# --- recommended actions -----------------------------------------------------

# category -> (id, priority, text)
ACTIONS = {
    "service_recovery": (
        "REC-001",
        10,
        "Launch a 30-day service recovery plan with daily KPI reviews covering compliance rate, backlog burn-down, and p90 resolution time.",
    ),
    "sla_management": (
        "REC-002",
        20,
        "Review SLA ownership by agency and enforce response-time playbooks for high-volume request categories.",
    ),
    "backlog_management": (
        "REC-003",
        30,
        "Create a rolling backlog-burn plan with weekly targets and dedicated teams for unresolved tickets.",
    ),
    "resolution_flow": (
        "REC-004",
        40,
        "Segment requests by complexity and route complex cases to specialized queues to reduce long-tail resolution delays.",
    ),
    "complaint_type_redesign": (
        "REC-005",
        50,
        "Prioritize process redesign and staffing for these complaint types.",
    ),
    "borough_operations": (
        "REC-006",
        60,
        "Deploy targeted field support and operational monitoring in the affected boroughs.",
    ),
}

# given when nothing else applies
FALLBACK_ACTIONS = {
    "monitoring": (
        "REC-900",
        900,
        "Maintain current operating cadence and continue monitoring SLA, backlog, and resolution-time trends.",
    ),
    "alerting": (
        "REC-901",
        910,
        "Set automated alert thresholds for sudden changes in complaint volume, breach rate, or unresolved workload.",
    ),
}
FALLBACK_TRIGGER = "no actionable insights were generated"
FALLBACK_STRENGTH = 1

# (category, words that must all occur in the lower-cased sentence, strength);
# the strongest row of a category counts
KEYWORDS = (
    ("service_recovery", ("critical",), 100),
    ("service_recovery", ("needs_attention",), 90),
    ("sla_management", ("breach rate",), 85),
    ("sla_management", ("sla compliance",), 75),
    ("backlog_management", ("backlog",), 80),
    ("resolution_flow", ("resolution time",), 70),
    ("resolution_flow", ("long-tail",), 70),
    ("complaint_type_redesign", ("impact complaint categories",), 65),
    ("borough_operations", ("boroughs", "slower"), 65),
)

# signal -> category it supports
SIGNALS = {
    "priority_complaint_types": "complaint_type_redesign",
    "priority_boroughs": "borough_operations",
}
SIGNAL_STRENGTH = 95
