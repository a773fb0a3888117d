"""The registered queries: every operator over whole tables.

Days and parsed times are shown as text and doubles rounded to six places, so
that results compare exactly with other engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import fixed_values as fixed
from caseflow.functions import report_json
from caseflow.operators import (
    actions,
    cells,
    clean,
    features,
    frames,
    insights,
    kpis,
    quality,
    schema,
    selection,
)
from caseflow.plans import views
from caseflow.plans.kept import KeptReports
from caseflow.sources import records, snapshots, windows

AS_OF = "2001-08-02"
EVENTS_AS_OF = date(2024, 1, 25)
SCAN_LIMIT = 5000

Query = Callable[[SparkSession, str], DataFrame]


def _shown(df: DataFrame) -> DataFrame:
    changes: dict[str, Column] = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DoubleType):
            changes[field.name] = F.round(field.name, 6)
        elif isinstance(field.dataType, T.DateType):
            changes[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType):
            changes[field.name] = F.array_join(field.name, " | ")
    return df.withColumns(changes) if changes else df


def _time_text(*names: str) -> dict[str, Column]:
    return {n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names}


# --- request records at the stages of a run ----------------------------------------


def _typed_rows(spark: SparkSession, sf_dir: str, segments: Sequence[str] = views.SEGMENTS):
    typed = views.requests(spark, sf_dir, segments)
    return kpis.measures(features.add_resolution(typed), AS_OF)


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(views.raw_requests(spark, sf_dir))


def _clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.measures(features.add_features(_cleaned(spark, sf_dir)), AS_OF)


# --- scans ---------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events")


def window_scan(spark, sf_dir):
    return windows.window_scan(
        _events(spark, sf_dir), "ts", date(2024, 1, 5), date(2024, 1, 20), SCAN_LIMIT, ["event_id"]
    )


def window_scan_default(spark, sf_dir):
    start, end = windows.window_days(as_of=EVENTS_AS_OF)
    return windows.window_scan(_events(spark, sf_dir), "ts", start, end, None, ["event_id"])


def window_scan_fallback(spark, sf_dir):
    return windows.window_scan_or_latest(
        _events(spark, sf_dir), "ts", date(2030, 1, 1), date(2030, 1, 31), SCAN_LIMIT, ["event_id"]
    )


def window_scan_hit(spark, sf_dir):
    return windows.window_scan_or_latest(
        _events(spark, sf_dir), "ts", date(2024, 1, 5), date(2024, 1, 20), SCAN_LIMIT, ["event_id"]
    )


def first_tenth(spark, sf_dir):
    """The first tenth of all events by hour, ties by user, kind and id: a limit that grows with the table."""
    events = _events(spark, sf_dir)
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return selection.smallest_rows(events, hour, ["user_id", "event_type", "event_id"], events.count() // 10)


def window_normalise(spark, sf_dir):
    """A window per event: reversed, future and date-time bounds all occur."""
    end = F.expr("timestampadd(DAY, user_id % 41 - 20, ts)")
    start_text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    low, high = windows.normalize_window(
        start_text, F.date_format(end, "yyyy-MM-dd"), F.lit("2024-01-20").cast("date")
    )
    return _shown(
        _events(spark, sf_dir).select(
            "event_id", low.alias("window_start"), high.alias("window_end")
        )
    )


def window_scan_text(spark, sf_dir):
    """A year of untidy text dates in three formats, from its first day to its last second."""
    return windows.window_scan(
        views.raw_requests(spark, sf_dir), "created_date", date(1996, 1, 1), date(1996, 12, 31)
    )


# --- schema and quality ------------------------------------------------------------------


def alias_normalise(spark, sf_dir):
    return schema.normalize_aliases(views.aliased_requests(spark, sf_dir))


def quality_counts(spark, sf_dir):
    return _shown(
        quality.field_quality(views.raw_requests(spark, sf_dir)).select(
            "field", "row_count", "null_count", "null_rate", "malformed_count", "all_null", "high_null"
        )
    )


def _verdict(df: DataFrame, formats: Sequence[str] = fixed.TIMESTAMP_FORMATS) -> DataFrame:
    _, table_verdict = quality.read_verdict(df, formats)
    return _shown(
        table_verdict.select(
            "is_valid",
            "row_count",
            "errors",
            "warnings",
            "missing_fields",
            "high_null_fields",
            F.transform(
                F.map_entries("alias_resolution"), lambda e: F.concat_ws("=", e["key"], e["value"])
            ).alias("alias_resolution"),
        )
    )


def quality_verdict(spark, sf_dir):
    return _verdict(views.aliased_requests(spark, sf_dir))


def quality_verdict_valid(spark, sf_dir):
    return _verdict(views.iso_requests(spark, sf_dir))


def quality_verdict_formats(spark, sf_dir):
    """Dates written another way are valid to a run that states their format."""
    slashed = views.iso_requests(spark, sf_dir).withColumns(
        {f: F.regexp_replace(f, r"^(\d+)-(\d+)-(\d+)T.*", "$3/$2/$1") for f in fixed.DATE_FIELDS}
    )
    return _verdict(slashed, ("dd/MM/yyyy",))


def quality_verdict_missing(spark, sf_dir):
    return _verdict(views.raw_requests(spark, sf_dir).drop("complaint_type", "borough"))


def quality_verdict_all_null(spark, sf_dir):
    no_due = views.iso_requests(spark, sf_dir).withColumn("due_date", F.lit(None).cast("string"))
    return _verdict(no_due)


def _gate(df: DataFrame) -> DataFrame:
    table_verdict = quality.verdict(df)
    passed = frames.row_count(quality.gate(df, table_verdict))
    return table_verdict.select(
        "is_valid",
        F.col("row_count").alias("rows_in"),
        passed.scalar().alias("rows_passed"),
    )


def quality_gate_pass(spark, sf_dir):
    return _gate(views.iso_requests(spark, sf_dir))


def quality_gate_fail(spark, sf_dir):
    return _gate(views.raw_requests(spark, sf_dir))


def profile_columns(spark, sf_dir):
    return _shown(quality.profile(views.raw_requests(spark, sf_dir)))


# --- rows ------------------------------------------------------------------------------------


def clean_dedup(spark, sf_dir):
    return _cleaned(spark, sf_dir)


def clean_dedup_narrow(spark, sf_dir):
    return clean.clean(views.raw_requests(spark, sf_dir), narrow=True)


def parse_timestamps(spark, sf_dir):
    parsed = features.add_times(views.raw_requests(spark, sf_dir))
    return parsed.withColumns(_time_text("created_ts", "due_ts", "closed_ts")).select(
        "unique_key",
        *[f"{t}_ts" for t in ("created", "due", "closed")],
        *[f"{t}_ts_parse_failed" for t in ("created", "due", "closed")],
    )


def parse_typed(spark, sf_dir):
    """Columns that are typed already: a fraction of a second, a date, a zoned time."""
    typed = views.requests(spark, sf_dir, ()).select(
        "unique_key",
        F.expr("timestampadd(MICROSECOND, 500001, created_ts)").alias("created_date"),
        F.to_date("due_ts").alias("due_date"),
        F.col("closed_ts").cast("timestamp").alias("closed_date"),
    )
    stems = ("created", "due", "closed")
    parsed = features.add_times(typed)
    return parsed.select(
        "unique_key",
        *[F.date_format(f"{t}_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f"{t}_ts") for t in stems],
        *[f"{t}_ts_parse_failed" for t in stems],
    )


def sla_features(spark, sf_dir):
    return features.add_features(_cleaned(spark, sf_dir)).select(
        "unique_key", "resolution_time_days", "resolution_completed", "sla_breach"
    )


def resolution_features(spark, sf_dir):
    return features.add_resolution(views.requests(spark, sf_dir, ())).select(
        "unique_key", "resolution_time_days", "resolution_completed", "sla_breach"
    )


def kpi_measures(spark, sf_dir):
    return _shown(
        _clean_rows(spark, sf_dir).select(
            "unique_key", "complaint_type", "resolution_time_days", "sla_breach_int", "is_open",
            "is_closed", "created_day", "age_days", "age_bucket",
        )
    )


def _backfilled(df: DataFrame) -> DataFrame:
    return kpis.backfill(df).withColumns(_time_text("created_ts", "closed_ts")).select(
        "unique_key", "created_ts", "closed_ts", "resolution_time_days", "sla_breach"
    )


def backfill_columns(spark, sf_dir):
    return _backfilled(_cleaned(spark, sf_dir).drop("closed_date"))


def backfill_from_text(spark, sf_dir):
    return _backfilled(_cleaned(spark, sf_dir))


# --- KPIs --------------------------------------------------------------------------------------


def _ranked(report: DataFrame) -> DataFrame:
    """A bounded report with the place at which it gives each row."""
    emitted = report.withColumn("_place", F.monotonically_increasing_id())
    order = Window.partitionBy(F.lit(1)).orderBy("_place")
    return _shown(emitted.withColumn("place", F.row_number().over(order)).drop("_place"))


def kpi_summary(spark, sf_dir):
    return _shown(kpis.summary(_typed_rows(spark, sf_dir, ())))


def kpi_summary_clean(spark, sf_dir):
    return _shown(kpis.summary(_clean_rows(spark, sf_dir)))


def ses_by_agency(spark, sf_dir):
    by_agency = kpis.with_ses(kpis.segment_kpis(_typed_rows(spark, sf_dir, ("agency",)), ["agency"]))
    return _shown(by_agency.select("agency", *kpis.SUMMARY_COLUMNS))


def kpi_daily_trend(spark, sf_dir):
    return _ranked(kpis.daily_trend(_typed_rows(spark, sf_dir, ())))


def kpi_top_types(spark, sf_dir):
    return _ranked(kpis.top_types(_clean_rows(spark, sf_dir)))


def kpi_type_impact(spark, sf_dir):
    return _ranked(kpis.type_impact(kpis.top_types(_clean_rows(spark, sf_dir))))


def kpi_top_agencies(spark, sf_dir):
    return _ranked(kpis.top_agencies(_typed_rows(spark, sf_dir, ("agency",))))


def kpi_boroughs(spark, sf_dir):
    return _ranked(kpis.borough_performance(_typed_rows(spark, sf_dir, ("borough",))))


def kpi_backlog_ageing(spark, sf_dir):
    return _ranked(kpis.backlog_ageing(_clean_rows(spark, sf_dir)))


def kpi_agency_type(spark, sf_dir):
    return _ranked(kpis.agency_types(_typed_rows(spark, sf_dir, ("agency", "complaint_type"))))


def kpi_status(spark, sf_dir):
    return _ranked(kpis.status_breakdown(_typed_rows(spark, sf_dir, ("status",))))


_CUBE_COLUMNS = (
    "scope", "report_rank", "created_day", "agency", "complaint_type", "borough", "age_bucket",
    "status", "total_requests", "open_requests", "closed_requests", "avg_resolution_time",
    "median_resolution_time", "p90_resolution_time", "sla_breach_count", "sla_observed_count",
    "sla_breach_rate", "sla_compliance_rate", "open_rate", "avg_age_days", "ses_score", "ses_band",
)


def kpi_cube(spark, sf_dir):
    return _shown(kpis.kpi_cube(_typed_rows(spark, sf_dir)).select(*_CUBE_COLUMNS))


def _pack(rows: DataFrame) -> DataFrame:
    return kpis.kpi_pack(kpis.kpi_cube(rows))


def kpi_pack(spark, sf_dir):
    """The pack's figures and structs, and all fields of its lists as text in list order."""
    return _shown_pack(_pack(_clean_rows(spark, sf_dir)))


def _kept(spark, rows: DataFrame, slices: int, sketch_keys: tuple[str, ...] = ()) -> KeptReports:
    """The rows kept in so many batches, by a hash of their day; one of them is added twice.

    The rows are computed once and written by slice, so that a batch reads its own rows only.
    """
    folder = snapshots.shared_folder(spark)
    kept = KeptReports(spark, snapshots.snapshot_path(folder, "kept"))
    own = F.pmod(F.xxhash64("created_day"), F.lit(slices)).cast("int").alias("slice")
    needed = rows.select(*[c for c in cells.READ if c in rows.columns], own)
    held = snapshots.write_rows(needed, snapshots.snapshot_path(folder, "sliced"), "slice")
    for i in [*range(slices), 0]:
        kept.add(f"slice {i}", held.filter(F.col("slice") == i), sketch_keys)
    return kept


def kpi_pack_kept(spark, sf_dir):
    """The pack of two kept batches, which is that of their union."""
    return _shown_pack(_kept(spark, _clean_rows(spark, sf_dir), 2).pack(AS_OF))


def _shown_pack(pack: DataFrame) -> DataFrame:
    def shown(value: Column, kind: T.DataType) -> Column:
        return F.format_string("%.9f", value) if isinstance(kind, T.DoubleType) else value.cast("string")

    def lines(name: str) -> Column:
        fields = pack.schema[name].dataType.elementType.fields
        return F.transform(
            name, lambda r: F.concat_ws(":", *[shown(r[f.name], f.dataType) for f in fields])
        ).alias(name)

    def struct(name: str) -> Column:
        fields = pack.schema[name].dataType.fields
        return F.concat_ws(":", *[shown(F.col(f"{name}.{f.name}"), f.dataType) for f in fields]).alias(name)

    return _shown(
        pack.select(
            *kpis.SUMMARY_COLUMNS,
            *[struct(n) for n in ("volume", "resolution", "sla")],
            *[lines(n) for n in (
                "time_trends", "top_complaint_types", "complaint_type_impact_top", "top_agencies",
                "borough_stats", "backlog_ageing", "agency_category_performance", "status_breakdown",
            )],
        )
    )


def median_approx(spark, sf_dir):
    """Per agency, whether the sketch's quantiles have the wanted rank, up to its error."""
    rows = _typed_rows(spark, sf_dir, ("agency",))
    sketched = kpis.segment_kpis(rows, ["agency"], "approx").select(
        "agency", "total_requests", "median_resolution_time", "p90_resolution_time"
    )
    return _in_rank(rows, sketched)


def median_merged(spark, sf_dir):
    """The same for sketch states of four slices, kept and merged."""
    rows = _typed_rows(spark, sf_dir, ("agency",))
    return _in_rank(rows, _kept(spark, rows, 4, ("agency",)).quantiles(("agency",)))


def _in_rank(rows: DataFrame, sketched: DataFrame) -> DataFrame:
    days = F.col("resolution_time_days")
    cells = rows.filter(days.isNotNull()).groupBy("agency", days.alias("days")).agg(F.count(F.lit(1)).alias("n"))
    checks = []
    for share, name in ((0.5, "median_resolution_time"), (0.9, "p90_resolution_time")):
        below = F.sum(F.when(F.col("days") < F.col(name), F.col("n")).otherwise(0)) / F.sum("n")
        upto = F.sum(F.when(F.col("days") <= F.col(name), F.col("n")).otherwise(0)) / F.sum("n")
        checks.append(((below - 1e-3 <= share) & (upto + 1e-3 >= share)).alias(name.replace("resolution_time", "in_rank")))
    return sketched.join(cells, "agency").groupBy("agency", "total_requests").agg(*checks)


# --- insights and actions -----------------------------------------------------------------------


def _segment_insights(rows: DataFrame, key: str) -> DataFrame:
    return insights.derive_insights(kpis.with_ses(kpis.segment_kpis(rows, [key])))


def _global_insights(spark, sf_dir) -> DataFrame:
    return insights.derive_insights(_pack(_typed_rows(spark, sf_dir)))


def insights_global(spark, sf_dir):
    return insights.insight_rows(_global_insights(spark, sf_dir), [])


def insights_by_agency(spark, sf_dir):
    found = _segment_insights(_typed_rows(spark, sf_dir, ("agency",)), "agency")
    return insights.insight_rows(found, ["agency"])


def insights_by_day(spark, sf_dir):
    found = _segment_insights(_typed_rows(spark, sf_dir, ()), "created_day")
    return _shown(insights.insight_rows(found, ["created_day"]))


def _district_rows(spark, sf_dir) -> DataFrame:
    """Districts by year of closing differ in speed, so the rule has something to find."""
    typed = views.requests(spark, sf_dir, ("complaint_type",)).withColumn(
        "borough", F.concat(F.lit("DISTRICT "), F.year("closed_ts").cast("string"))
    )
    return kpis.measures(features.add_resolution(typed), AS_OF)


def insights_slow_boroughs(spark, sf_dir):
    found = insights.derive_insights(_pack(_district_rows(spark, sf_dir)))
    return _shown(
        found.select(
            F.filter("insights", lambda i: i["rule"] == "slow_boroughs")[0]["text"].alias("insight"),
            F.col("signals.priority_boroughs").alias("priority_boroughs"),
            F.col("signals.priority_complaint_types").alias("priority_complaint_types"),
        )
    )


def actions_slow_boroughs(spark, sf_dir):
    """Actions where the borough rule fires, with its signal."""
    return _action_rows(insights.derive_insights(_pack(_district_rows(spark, sf_dir))), [])


def _action_rows(found: DataFrame, keys: list[str], rules: actions.Rules | None = None) -> DataFrame:
    return actions.recommend(found, keys, rules).select(
        *keys,
        "id",
        "category",
        "priority",
        "recommendation",
        F.size("evidence").alias("evidence_count"),
        F.col("strongest_evidence.source").alias("strongest_source"),
        F.col("strongest_evidence.trigger").alias("strongest_trigger"),
        F.col("strongest_evidence.evidence_strength").alias("strongest_strength"),
    )


def actions_global(spark, sf_dir):
    return _action_rows(_global_insights(spark, sf_dir), [])


def actions_from_rules(spark, sf_dir):
    """The same actions by rules that are read from a frame."""
    rules = actions.rules_of(actions.rule_frame(spark))
    return _action_rows(_global_insights(spark, sf_dir), [], rules)


def action_evidence(spark, sf_dir):
    made = actions.recommend(_global_insights(spark, sf_dir), [])
    return _shown(actions.evidence_rows(made, []))


def actions_by_agency(spark, sf_dir):
    found = _segment_insights(_typed_rows(spark, sf_dir, ("agency",)), "agency")
    return _action_rows(found, ["agency"])


def actions_by_day(spark, sf_dir):
    found = _segment_insights(_typed_rows(spark, sf_dir, ()), "created_day")
    return _shown(_action_rows(found, ["created_day"]))


# --- reports, helpers, snapshots -----------------------------------------------------------------


def report_rows(spark, sf_dir):
    rows = _typed_rows(spark, sf_dir, ("agency", "borough", "status"))
    figures = rows.groupBy("agency", "status").agg(
        report_json.sorted_set(F.collect_set("borough")).alias("boroughs"),
        F.min("created_ts").alias("first_created"),
        F.max("created_day").alias("last_day"),
        (F.count(F.lit(1)).cast("decimal(18,2)") / F.lit(4).cast("decimal(2,0)"))
        .cast("decimal(18,2)")
        .alias("quarter"),
        F.max(F.when(F.col("is_open") > 1, F.col("age_days"))).alias("nothing"),
    )
    return report_json.report_json(figures)


def distinct_values(spark, sf_dir):
    return frames.distinct_values(views.requests(spark, sf_dir, ("agency",)), "agency")


def group_dict(spark, sf_dir):
    rows = views.requests(spark, sf_dir, ("agency", "status"))
    grouped = frames.group_by(
        rows, ["agency", "status"], {"unique_key": "count", "created_ts": "max"}
    )
    return grouped.withColumnsRenamed(
        {"count(unique_key)": "requests", "max(created_ts)": "last_created"}
    ).withColumns(_time_text("last_created"))


def group_keys(spark, sf_dir):
    return frames.group_by(views.requests(spark, sf_dir, ("agency", "status")), ["agency", "status"])


def row_count(spark, sf_dir):
    return frames.row_count(views.raw_requests(spark, sf_dir))


def raw_snapshot(spark, sf_dir):
    """Raw records written as JSON lines and read again with inferred names."""
    folder = snapshots.snapshot_path(snapshots.shared_folder(spark), "raw")
    raw = views.raw_requests(spark, sf_dir)
    snapshots.write_snapshot(raw, folder)
    return records.read_records(spark, folder, "ndjson").select(*raw.columns)


#: Records of one array file, which one task holds and reads.
ROWS_PER_ARRAY = 10_000


def array_scan(spark, sf_dir):
    """Raw records written as files that hold one array each, and read again as such."""
    folder = snapshots.snapshot_path(snapshots.shared_folder(spark), "arrays")
    raw = views.raw_requests(spark, sf_dir)
    files = -(-raw.count() // ROWS_PER_ARRAY)
    texts = raw.select(F.pmod(F.xxhash64(*raw.columns), F.lit(max(1, files))).alias("file"), F.to_json(F.struct(*raw.columns)).alias("record"))
    array = F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]"))
    texts.groupBy("file").agg(array.alias("value")).write.partitionBy("file").text(folder, compression="lz4")
    return records.read_records(spark, folder, "json").select(*raw.columns)


def processed_snapshot(spark, sf_dir):
    """Cleaned records with features, written and read with the written schema."""
    folder = snapshots.snapshot_path(snapshots.shared_folder(spark), "processed")
    done = features.add_features(_cleaned(spark, sf_dir))
    snapshots.write_snapshot(done, folder)
    back = snapshots.read_snapshot(spark, folder, done.schema)
    return back.withColumns(_time_text("created_ts", "due_ts", "closed_ts"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        window_scan, window_scan_default, window_scan_fallback, window_scan_hit, window_scan_text, window_normalise,
        first_tenth,
        alias_normalise, quality_counts, quality_verdict, quality_verdict_valid,
        quality_verdict_formats, quality_verdict_missing, quality_verdict_all_null, quality_gate_pass, quality_gate_fail,
        profile_columns, clean_dedup, clean_dedup_narrow, parse_timestamps, parse_typed, sla_features, resolution_features,
        kpi_measures, backfill_columns, backfill_from_text, kpi_summary, kpi_summary_clean,
        ses_by_agency, kpi_daily_trend, kpi_top_types, kpi_type_impact, kpi_top_agencies,
        kpi_boroughs, kpi_backlog_ageing, kpi_agency_type, kpi_status, kpi_cube, kpi_pack, kpi_pack_kept,
        median_approx, median_merged, insights_global, insights_by_agency, insights_by_day,
        insights_slow_boroughs, actions_global, actions_from_rules, action_evidence, actions_by_agency,
        actions_by_day, actions_slow_boroughs, report_rows, distinct_values, group_dict, group_keys, row_count,
        raw_snapshot, processed_snapshot, array_scan,
    )
}
