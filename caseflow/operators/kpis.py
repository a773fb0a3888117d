"""KPIs per scope: the whole table, a day, an agency, a complaint type, ...

All figures come from *cells*: counts and sums per reporting key, with the
whole days of resolution as one more key where a quantile is wanted. Cells are
built by a plain hash aggregate, so each map task sends at most one row per
cell, however skewed the keys are. All sums are integers, so results do not
depend on the order in which partial sums meet. An exact discrete quantile is
the first day count at which the running count of the cells reaches its share;
cells per key are bounded by the number of distinct day counts.

``kpi_cube`` reads the rows once for all reports. Three small grains are
enough for the first aggregate, instead of one grouping set per report:

* agency, complaint type, resolution days -> whole table, agency, type, pair
* created day -> daily trend, backlog age
* borough, status -> borough, status
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import fixed_values as fixed
from caseflow.functions import scores, times

SEGMENTS = ("agency", "complaint_type", "borough", "status")
DAYS = "resolution_time_days"

# what a cell holds; each is a count or an integer sum, so cells add up
TALLIES = (
    "total_requests",
    "open_requests",
    "closed_requests",
    "days_sum",
    "days_known",
    "sla_breach_count",
    "sla_observed_count",
    "open_age_sum",
    "open_age_known",
)


@dataclass(frozen=True)
class Limits:
    top_n: int = fixed.TOP_N
    trend_points: int = fixed.TREND_POINTS
    agency_category: int = fixed.AGENCY_CATEGORY_LIMIT


# --- row-level measures --------------------------------------------------------


def backfill(df: DataFrame, formats: Sequence[str] = fixed.TIMESTAMP_FORMATS) -> DataFrame:
    """Derived columns that a frame lacks: parsed from raw text, else NULL."""
    for stem in ("created", "closed"):
        if f"{stem}_ts" not in df.columns:
            has_raw = f"{stem}_date" in df.columns
            df = df.withColumn(
                f"{stem}_ts",
                times.parse_column(df, f"{stem}_date", formats)
                if has_raw
                else F.lit(None).cast("timestamp_ntz"),
            )
    if DAYS not in df.columns:
        df = df.withColumn(DAYS, F.datediff("closed_ts", "created_ts"))
    if "sla_breach" not in df.columns:
        df = df.withColumn("sla_breach", F.lit(None).cast("int"))
    return df


def require_sla(df: DataFrame) -> DataFrame:
    """For callers that must not report on rows without SLA features."""
    if "sla_breach" not in df.columns:
        raise ValueError("an sla_breach column is required; derive the features first")
    return df


def measures(
    df: DataFrame,
    as_of: str | date | Column | None = None,
    formats: Sequence[str] = fixed.TIMESTAMP_FORMATS,
) -> DataFrame:
    """Row-level KPI inputs; open means no parsed close time, whatever the status."""
    df = backfill(df, formats)
    created_day = F.to_date("created_ts")
    age = times.age_in_days(created_day, as_of)
    is_open = F.col("closed_ts").isNull()
    return df.withColumns(
        {
            DAYS: scores.non_negative(F.col(DAYS)),
            "sla_breach_int": F.col("sla_breach").cast("int"),
            "is_open": is_open.cast("int"),
            "is_closed": (~is_open).cast("int"),
            "created_day": created_day,
            "age_days": age,
            "age_bucket": F.when(is_open, times.age_bucket(age)),
            **{name: scores.labelled(F.col(name)) for name in SEGMENTS if name in df.columns},
        }
    )


# --- cells ---------------------------------------------------------------------


def _tally_rows() -> list[Column]:
    sources = (
        "count(*)",
        "sum(is_open)",
        "sum(is_closed)",
        f"sum({DAYS})",
        f"count({DAYS})",
        "sum(sla_breach_int)",
        "count(sla_breach_int)",
        "sum(if(is_open = 1, age_days, NULL))",
        "count(if(is_open = 1, age_days, NULL))",
    )
    return [F.expr(f"{source} AS {name}") for source, name in zip(sources, TALLIES, strict=True)]


def _add_tallies() -> list[Column]:
    return [F.expr(f"sum({name}) AS {name}") for name in TALLIES]


def _quantiles(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells per (keys, days) -> one row per keys with exact p50 and p90."""
    key = f"PARTITION BY {', '.join(keys) or '1'} ORDER BY {DAYS}"
    running = cells.selectExpr(
        "*",
        f"sum(days_known) OVER ({key}) AS _reached",
        f"sum(days_known) OVER ({key} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        " AS _known",
    )
    return running.groupBy(*keys).agg(
        *_add_tallies(),
        F.expr(f"min(if(_reached >= 0.5D * _known, {DAYS}, NULL)) AS median_resolution_time"),
        F.expr(f"min(if(_reached >= 0.9D * _known, {DAYS}, NULL)) AS p90_resolution_time"),
    )


def _kpi_columns(df: DataFrame) -> DataFrame:
    """Tallies -> reported figures; what is unknown is reported as 0."""
    keys = [c for c in df.columns if c not in TALLIES and c not in _QUANTILES]
    quantiles = [c for c in _QUANTILES if c in df.columns]
    return df.selectExpr(
        *keys,
        *[f"coalesce({c}, 0L) AS {c}" for c in TALLIES if c.endswith(("_requests", "_count"))],
        *[f"coalesce(double({c}), 0.0D) AS {c}" for c in quantiles],
        "coalesce(try_divide(days_sum, days_known), 0.0D) AS avg_resolution_time",
        "coalesce(try_divide(open_age_sum, open_age_known), 0.0D) AS avg_age_days",
        "coalesce(try_divide(sla_breach_count, sla_observed_count), 0.0D) AS sla_breach_rate",
        "1 - coalesce(try_divide(sla_breach_count, sla_observed_count), 0.0D)"
        " AS sla_compliance_rate",
        "coalesce(try_divide(open_requests, total_requests), 0.0D) AS open_rate",
        "coalesce(try_divide(closed_requests, total_requests), 0.0D) AS closed_rate",
    )


_QUANTILES = ("median_resolution_time", "p90_resolution_time")


def with_ses(df: DataFrame) -> DataFrame:
    """Efficiency score and band; the open rate is the backlog."""
    score = scores.ses_score(
        F.col("open_rate"), F.col("sla_compliance_rate"), F.col("avg_resolution_time")
    )
    return df.withColumns(
        {
            "backlog_ratio": F.col("open_rate"),
            "sla_rate": F.col("sla_compliance_rate"),
            "ses_score": score,
            "ses_band": scores.ses_band(score),
        }
    )


def segment_kpis(
    rows: DataFrame, keys: Sequence[str], quantiles: str | None = "exact"
) -> DataFrame:
    """KPIs per key of ``measures`` rows; no keys means one row for the table.

    ``quantiles`` is ``"exact"``, ``"approx"`` (Spark's sketch at its default
    accuracy: no second stage, smaller state on very wide value ranges) or
    None.
    """
    keys = list(keys)
    if any(k not in rows.columns for k in keys):
        # a table without the segment reports nothing for it
        rows = rows.withColumns(
            {k: F.lit(None).cast("string") for k in keys if k not in rows.columns}
        ).filter(F.lit(False))
    if quantiles == "exact":
        tallied = _quantiles(rows.groupBy(*keys, DAYS).agg(*_tally_rows()), keys)
    elif quantiles == "approx":
        tallied = rows.groupBy(*keys).agg(
            *_tally_rows(),
            F.percentile_approx(DAYS, 0.5).alias("median_resolution_time"),
            F.percentile_approx(DAYS, 0.9).alias("p90_resolution_time"),
        )
    elif quantiles is None:
        tallied = rows.groupBy(*keys).agg(*_tally_rows())
    else:
        raise ValueError(f"quantiles must be 'exact', 'approx' or None, not {quantiles!r}")
    return _kpi_columns(tallied)


# --- reports -------------------------------------------------------------------


def summary(rows: DataFrame, quantiles: str = "exact") -> DataFrame:
    """One row: volume, resolution, SLA and efficiency of the whole table."""
    return with_ses(segment_kpis(rows, [], quantiles)).select(*SUMMARY_COLUMNS)


SUMMARY_COLUMNS = (
    "total_requests", "open_requests", "closed_requests", "open_rate", "closed_rate",
    "backlog_ratio", "avg_resolution_time", "median_resolution_time", "p90_resolution_time",
    "sla_breach_count", "sla_observed_count", "sla_breach_rate", "sla_compliance_rate",
    "sla_rate", "ses_score", "ses_band",
)
TREND_COLUMNS = (
    "created_day", "total_requests", "open_requests", "closed_requests",
    "avg_resolution_time", "sla_breach_rate",
)
SEGMENT_COLUMNS = (
    "total_requests", "open_requests", "closed_requests", "avg_resolution_time",
    "median_resolution_time", "sla_breach_rate", "sla_compliance_rate",
)
TYPE_COLUMNS = ("complaint_type", *SEGMENT_COLUMNS, "volume_share", "impact_score")
AGENCY_COLUMNS = ("agency", *SEGMENT_COLUMNS)
BOROUGH_COLUMNS = (
    "borough", "total_requests", "open_requests", "closed_requests", "open_rate",
    "avg_resolution_time", "sla_breach_rate", "sla_compliance_rate",
)
AGE_COLUMNS = ("age_bucket", "open_count", "avg_age_days")
PAIR_COLUMNS = ("agency", "complaint_type", *SEGMENT_COLUMNS, "closed_rate")
STATUS_COLUMNS = ("status", "total_requests")


def _top(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return df.orderBy(F.desc("total_requests"), *[F.asc(k) for k in keys]).limit(limit)


def daily_trend(rows: DataFrame, points: int = fixed.TREND_POINTS) -> DataFrame:
    """The latest days with rows, oldest first."""
    days = segment_kpis(rows.filter(F.col("created_day").isNotNull()), ["created_day"], None)
    latest = days.orderBy(F.desc("created_day")).limit(points)
    return latest.orderBy("created_day").select(*TREND_COLUMNS).withColumnRenamed(
        "total_requests", "volume"
    )


_IMPACT = "volume_share * sla_breach_rate * greatest(avg_resolution_time, 0.0D)"


def _with_impact(df: DataFrame) -> DataFrame:
    """Share of all rows, and impact; ``df`` is a bounded report with an ``all`` row."""
    share = "coalesce(try_divide(total_requests, max(if(scope = 'all', total_requests, NULL)) OVER (PARTITION BY 1)), 0.0D)"
    return df.selectExpr("*", f"{share} AS volume_share").selectExpr(
        "*",
        f"{_IMPACT} AS impact_score",
    )


def top_types(rows: DataFrame, top_n: int = fixed.TOP_N) -> DataFrame:
    """Largest complaint types with their share of all rows and impact score.

    The grand total is the sum over the types, one row each, before the limit.
    """
    types = segment_kpis(rows, ["complaint_type"])
    total = F.sum("total_requests").over(Window.partitionBy(F.lit(1)))
    types = types.withColumn("volume_share", F.coalesce(F.try_divide("total_requests", total), F.lit(0.0)))
    types = types.withColumn("impact_score", F.expr(_IMPACT))
    return _top(types, ["complaint_type"], top_n).select(*TYPE_COLUMNS)


def type_impact(types: DataFrame, limit: int = fixed.IMPACT_LIMIT) -> DataFrame:
    """``top_types`` rows by impact; small but harmful types are not among them."""
    return types.orderBy(
        F.desc("impact_score"), F.desc("total_requests"), "complaint_type"
    ).limit(limit)


def top_agencies(rows: DataFrame, top_n: int = fixed.TOP_N) -> DataFrame:
    return _top(segment_kpis(rows, ["agency"]), ["agency"], top_n).select(*AGENCY_COLUMNS)


def borough_performance(rows: DataFrame, top_n: int = fixed.TOP_N) -> DataFrame:
    kpis = segment_kpis(rows, ["borough"], quantiles=None)
    return _top(kpis, ["borough"], top_n).select(*BOROUGH_COLUMNS)


def backlog_ageing(rows: DataFrame) -> DataFrame:
    """Open rows by age bucket, youngest first, unknown age last."""
    buckets = segment_kpis(rows.filter(F.col("is_open") == 1), ["age_bucket"], quantiles=None)
    return (
        buckets.withColumnRenamed("open_requests", "open_count")
        .orderBy(times.age_bucket_rank(F.col("age_bucket")))
        .select(*AGE_COLUMNS)
    )


def agency_types(rows: DataFrame, limit: int = fixed.AGENCY_CATEGORY_LIMIT) -> DataFrame:
    keys = ["agency", "complaint_type"]
    return _top(segment_kpis(rows, keys), keys, limit).select(*PAIR_COLUMNS)


def status_breakdown(rows: DataFrame, top_n: int = fixed.TOP_N) -> DataFrame:
    kpis = segment_kpis(rows, ["status"], quantiles=None)
    return _top(kpis, ["status"], top_n).select(*STATUS_COLUMNS)


# --- all reports in one pass ----------------------------------------------------

SCOPE_KEYS = {
    "all": (),
    "created_day": ("created_day",),
    "complaint_type": ("complaint_type",),
    "agency": ("agency",),
    "borough": ("borough",),
    "age_bucket": ("age_bucket",),
    "agency_complaint_type": ("agency", "complaint_type"),
    "status": ("status",),
}
# how the keys of any scope are held while all scopes share one frame
_SHARED_KEYS = ("scope", "created_day", "first_key", "second_key")

# scopes that share a first aggregate, and a column it always groups by
_GRAINS = (
    (("all", "agency", "complaint_type", "agency_complaint_type"), (DAYS,)),
    (("created_day", "age_bucket"), ()),
    (("borough", "status"), ()),
)


def _grains(scopes: Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(scopes, columns to group by) of every grain that is needed."""
    needed = []
    for members, always in _GRAINS:
        wanted = [s for s in members if s in scopes]
        if wanted:
            keys = [k for s in wanted for k in SCOPE_KEYS[s]]
            needed.append((wanted, [*always, *dict.fromkeys(keys)]))
    return needed


def scope_member(scope: str) -> str:
    """A cell's place in a scope, as a struct of the shared keys."""
    keys = SCOPE_KEYS[scope]
    day = "created_day" if "created_day" in keys else "NULL"
    texts = [k for k in keys if k != "created_day"] + ["NULL", "NULL"]
    return (
        f"named_struct('scope', '{scope}', 'created_day', date({day}),"
        f" 'first_key', string({texts[0]}), 'second_key', string({texts[1]}))"
    )


def _scoped(rows: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """One row per scope and key with tallies and quantiles; reads the rows once."""
    grains = _grains(scopes)
    columns = list(dict.fromkeys(c for _, keys in grains for c in keys))
    # the first column of a grain is in no other grain, so it tells whose cell it is
    markers = [keys[0] for _, keys in grains]
    cells = rows.groupingSets([[F.col(c) for c in keys] for _, keys in grains], *columns).agg(
        *_tally_rows(), *[F.grouping(m).alias(f"_rolled_{m}") for m in markers]
    )

    memberships = " ".join(
        f"WHEN _rolled_{marker} = 0 THEN array({', '.join(scope_member(s) for s in wanted)})"
        for (wanted, _), marker in zip(grains, markers)
    )
    days = DAYS if DAYS in columns else f"CAST(NULL AS int) AS {DAYS}"
    spread = cells.selectExpr(*TALLIES, days, f"inline(CASE {memberships} END)").filter(
        # undated rows are on no day, and closed rows have no age
        "(scope <> 'created_day' OR created_day IS NOT NULL)"
        " AND (scope <> 'age_bucket' OR first_key IS NOT NULL)"
    )
    return scopes_of(spread)


def scopes_of(spread: DataFrame) -> DataFrame:
    """Tallies and quantiles per scope and key of cells, spread over their scopes."""
    return _quantiles(spread.groupBy(*_SHARED_KEYS, DAYS).agg(*_add_tallies()), _SHARED_KEYS)


def _named_keys() -> list[str]:
    """The shared keys under the names they have in each scope."""
    named = []
    for name in ("agency", "complaint_type", "borough", "age_bucket", "status"):
        held = " ".join(
            f"WHEN '{scope}' THEN {_SHARED_KEYS[2 + keys.index(name)]}"
            for scope, keys in SCOPE_KEYS.items()
            if name in keys
        )
        named.append(f"CASE scope {held} END AS {name}")
    return named


def available_scopes(rows: DataFrame) -> list[str]:
    """Scopes whose segment columns the rows have."""
    return [
        scope
        for scope, keys in SCOPE_KEYS.items()
        if all(k in rows.columns for k in keys)
    ]


def kpi_cube(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All reports as one bounded frame: scope, rank in the report, figures.

    Days rank by date, age buckets from young to old, all others by volume.
    """
    return cube_of_scopes(_scoped(rows, available_scopes(rows)), limits)


def cube_of_scopes(scoped: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``kpi_cube`` of tallies and quantiles per scope and key."""
    limit_of = {
        "all": 1,
        "created_day": limits.trend_points,
        "agency_complaint_type": limits.agency_category,
        "age_bucket": len(fixed.AGE_BUCKETS) + 2,
    }
    allowed = " ".join(f"WHEN '{scope}' THEN {limit}" for scope, limit in limit_of.items())
    with_quantiles = ", ".join(f"'{scope}'" for scope in _GRAINS[0][0])
    ranked = with_ses(_kpi_columns(scoped)).withColumns(
        {
            # known only where the scope's cells keep the day counts
            **{c: F.expr(f"if(scope IN ({with_quantiles}), {c}, NULL)") for c in _QUANTILES},
            "_first": F.when(F.col("scope") == "created_day", -F.unix_date("created_day"))
            .when(F.col("scope") == "age_bucket", times.age_bucket_rank(F.col("first_key")))
            .otherwise(-F.col("total_requests")),
        }
    ).selectExpr(
        "* EXCEPT (_first)",
        "row_number() OVER (PARTITION BY scope ORDER BY _first, first_key, second_key)"
        " AS report_rank",
    )
    # the plain bound lets Spark cut each report on the map side already
    largest = max(limits.top_n, *limit_of.values())
    return ranked.filter(
        f"report_rank <= {largest} AND report_rank <= CASE scope {allowed} ELSE {limits.top_n} END"
    ).selectExpr("* EXCEPT (first_key, second_key)", *_named_keys())


_PACK_LISTS = {
    # list in the pack -> (scope, columns)
    "time_trends": ("created_day", TREND_COLUMNS),
    "top_complaint_types": ("complaint_type", TYPE_COLUMNS),
    "top_agencies": ("agency", AGENCY_COLUMNS),
    "borough_performance": ("borough", BOROUGH_COLUMNS),
    "backlog_ageing": ("age_bucket", AGE_COLUMNS),
    "agency_category_performance": ("agency_complaint_type", PAIR_COLUMNS),
    "status_breakdown": ("status", STATUS_COLUMNS),
}


# summary of a table without rows, as far as it is not 0
_NO_ROWS = {
    "sla_compliance_rate": "1.0D",
    "sla_rate": "1.0D",
    "ses_score": f"{fixed.SES_BACKLOG_WEIGHT}D + {fixed.SES_COMPLIANCE_WEIGHT}D + {fixed.SES_SPEED_WEIGHT}D",
    "ses_band": f"'{fixed.SES_BANDS[0][1]}'",
}


def _fields(columns: Sequence[str], row: str = "", **renamed: str) -> str:
    return ", ".join(f"'{renamed.get(c, c)}', {row}{c}" for c in columns)


def kpi_pack(cube: DataFrame) -> DataFrame:
    """One row with the whole-table figures and every report as a list.

    Works on the bounded cube only (at most some hundred rows), so the single
    group that collects the lists does not grow with the data.
    """
    # the trend lists its days upwards
    rows = _with_impact(cube).selectExpr(
        "*",
        "if(scope = 'created_day', -report_rank, report_rank) AS _place",
        "open_requests AS open_count",
    )
    columns = list(dict.fromkeys(c for _, listed in _PACK_LISTS.values() for c in listed))
    everything = f"sort_array(collect_list(named_struct('scope', scope, '_place', _place, {_fields(columns)}))) AS _rows"
    whole = [
        f"coalesce(max(if(scope = 'all', {c}, NULL)), {_NO_ROWS.get(c, '0')}) AS {c}"
        for c in SUMMARY_COLUMNS
    ]
    packed = rows.groupBy().agg(*[F.expr(e) for e in (*whole, everything)])

    shown = []
    for name, (scope, columns) in _PACK_LISTS.items():
        renamed = {"total_requests": "volume"} if name == "time_trends" else {}
        shown.append(
            f"transform(filter(_rows, r -> r.scope = '{scope}'),"
            f" r -> named_struct({_fields(columns, 'r.', **renamed)})) AS {name}"
        )
    volume = ("total_requests", "open_requests", "closed_requests", "open_rate", "closed_rate")
    resolution = ("avg_resolution_time", "median_resolution_time", "p90_resolution_time")
    sla = {
        "sla_breach_count": "breach_count",
        "sla_breach_rate": "breach_rate",
        "sla_compliance_rate": "compliance_rate",
        "sla_observed_count": "observed_count",
    }
    return packed.selectExpr(*SUMMARY_COLUMNS, *shown).selectExpr(
        "*",
        f"named_struct({_fields(volume)}) AS volume",
        f"named_struct({_fields(resolution)}) AS resolution",
        f"named_struct({_fields(tuple(sla), **sla)}) AS sla",
        "borough_performance AS borough_stats",
        # equal impacts keep their order by volume
        f"""slice(
          transform(
            array_sort(transform(top_complaint_types, (t, i) -> struct(-t.impact_score, i, t))),
            e -> e.t),
          1, {fixed.IMPACT_LIMIT}) AS complaint_type_impact_top""",
    )
