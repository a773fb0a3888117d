"""A whole run: records in, lazy result frames out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import fixed_values as fixed
from caseflow.operators import actions, clean, features, insights, kpis, quality, schema
from caseflow.sources import records, snapshots, windows


@dataclass(frozen=True)
class Analysis:
    """Lazy results of one run; nothing is computed until one is used.

    ``pack``, ``insights`` and ``actions`` build on each other; to use several
    of them, write ``pack`` (one row) or persist it.
    """

    verdict: DataFrame
    records: DataFrame
    pack: DataFrame
    insights: DataFrame
    actions: DataFrame
    snapshot: str | None


def analyse(
    df: DataFrame,
    as_of: str | date | None = None,
    formats: Sequence[str] = fixed.TIMESTAMP_FORMATS,
    limits: kpis.Limits = kpis.Limits(),
    snapshot_path: str | None = None,
    gated: bool = True,
    renames: dict[str, str] | None = None,
    rules: actions.Rules | None = None,
) -> Analysis:
    """Aliases, verdict, gate, clean, features, KPIs, insights, actions.

    An invalid verdict leaves every later frame without rows; ``gated=False``
    goes on regardless. One set of ``formats`` serves checks, parsing and KPIs;
    ``renames`` are aliases resolved before; ``rules`` are the action rules. With a snapshot path one pass reads the raw
    records, counts what the verdict needs and writes the processed records as Parquet
    beside the path; the gate then is known, and the snapshot (JSON lines) and the KPIs
    are read from the Parquet.
    """
    named, table_verdict = quality.read_verdict(df, formats, renames)
    # the steps below read these; a table without them fails the gate anyway
    absent = [f for f in ("unique_key", *fixed.DATE_FIELDS) if f not in named.columns]

    def process(records: DataFrame) -> DataFrame:
        whole = records.withColumns({f: F.lit(None).cast("string") for f in absent})
        return features.add_features(clean.clean(whole), formats)

    written, staging = None, None
    if snapshot_path is not None:
        counts = quality.count_columns(named, formats)
        path = f"{snapshot_path.rstrip('/')}-rows"
        staging, figures = snapshots.try_stage_observed(df, path, named, counts, process)
        if figures is not None:
            schema = ", ".join(f"{name} long" for name in figures)
            counted = df.sparkSession.createDataFrame([tuple(figures.values())], schema)
            table_verdict = quality.read_verdict(df, formats, renames, counted)[1]
    kept = None
    if staging is not None:
        if gated and not table_verdict.first()["is_valid"]:
            snapshots.discard(df.sparkSession, staging)
            kept = process(named).filter(F.lit(False))
        else:
            kept = snapshots.try_publish(df.sparkSession, staging, path)
    processed = process(quality.gate(named, table_verdict) if gated else named) if kept is None else kept
    if kept is not None:
        written = snapshots.try_write_snapshot(kept, snapshot_path)
    rows = kpis.measures(kpis.require_sla(processed), as_of, formats)
    pack = kpis.kpi_pack(kpis.kpi_cube(rows, limits))
    if gated:
        pack = quality.gate(pack, table_verdict)
    found = insights.derive_insights(pack)
    return Analysis(
        verdict=table_verdict,
        records=processed,
        pack=pack,
        insights=found,
        actions=actions.recommend(found, [], rules),
        snapshot=written,
    )


def analyse_file(
    spark: SparkSession, path: str, format: str = "json", **options
) -> Analysis:
    """A run over record files."""
    return analyse(records.read_records(spark, path, format), **options)


def analyse_window(
    df: DataFrame,
    column: str = "created_date",
    start: str | date | None = None,
    end: str | date | None = None,
    as_of: date | None = None,
    limit: int | None = None,
    ties: Sequence[str] = ("unique_key",),
    formats: Sequence[str] = fixed.TIMESTAMP_FORMATS,
    day_column: str | None = None,
    **options,
) -> Analysis:
    """A run over the records of a date window, or the latest ones if it is empty.

    All records of the window count unless the caller states a ``limit``. Aliases
    are resolved first, so ``column`` is a canonical name.
    """
    first, last = windows.window_days(start, end, as_of)
    renames = schema.alias_map(df.columns)
    named = df.withColumnsRenamed(renames)
    ties = [t for t in ties if t in named.columns]
    scanned = windows.window_scan_or_latest(named, column, first, last, limit, ties, formats, day_column, ordered=False)
    return analyse(scanned, as_of=as_of, formats=formats, renames=renames, **options)
