"""Additive cells and sketch states that stand for records in later reports.

``day_cells`` sums records per created day and reporting keys. The sums are integers
and the resolution days a key, so cells of different records add up to the cells of
their union, and exact quantiles and all KPI reports follow from them. Ages are not in
the cells: they follow from the created day and the day of the report, whenever that is.

``sketch_states`` keeps mergeable quantile sketches per key, for values too many to be
keys of cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import times
from caseflow.operators import kpis
from caseflow.operators.kpis import DAYS

#: What a cell holds; ages are left to the report.
KEPT = kpis.TALLIES[:7]
#: Grains of the cells: their keys besides created day and whether a record is open.
GRAINS = {"work": ("agency", "complaint_type"), "borough": ("borough",), "status": ("status",)}
#: Columns of ``measures`` rows that cells and sketch states are made of.
READ = ("created_day", "is_open", "is_closed", DAYS, "sla_breach_int", *kpis.SEGMENTS)
#: Scopes that report on a grain's cells.
_SCOPES = {
    "work": ("all", "agency", "complaint_type", "agency_complaint_type", "created_day", "age_bucket"),
    "borough": ("borough",),
    "status": ("status",),
}
#: Accuracy of sketches: a rank error of some 0.0007.
SKETCH_SIZE = 8000


def day_cells(rows: DataFrame) -> DataFrame:
    """Cells of ``measures`` rows: one row per grain, created day and keys; the rows are read once."""
    grains = {"work": [DAYS, *[k for k in GRAINS["work"] if k in rows.columns]]}
    grains |= {g: list(keys) for g, keys in GRAINS.items() if g != "work" and keys[0] in rows.columns}
    shared = ["created_day", "is_open"]
    columns = [*shared, *[k for keys in grains.values() for k in keys]]
    tallies = [t for t, name in zip(kpis._tally_rows(), kpis.TALLIES) if name in KEPT]
    # the first key of a grain is in no other, so it tells whose cell it is
    marks = [F.grouping(keys[0]).alias(f"_rolled_{g}") for g, keys in grains.items()]
    sets = [[F.col(c) for c in (*shared, *keys)] for keys in grains.values()]
    cells = rows.groupingSets(sets, *columns).agg(*tallies, *marks)
    grain = F.coalesce(*[F.when(F.col(f"_rolled_{g}") == 0, F.lit(g)) for g in grains])
    held = [F.col(k) if k in columns else F.lit(None).cast("string").alias(k) for k in kpis.SEGMENTS]
    return cells.select(grain.alias("grain"), *shared, DAYS, *held, *KEPT)


def add_cells(cells: DataFrame) -> DataFrame:
    """Cells of several tables as one: equal keys are summed."""
    keys = [c for c in cells.columns if c not in KEPT]
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in KEPT])


def scopes_of_cells(cells: DataFrame, as_of: str | date | Column | None = None) -> DataFrame:
    """Tallies and quantiles per scope and key, as the KPI cube has them, with ages at ``as_of``."""
    age = times.age_in_days(F.col("created_day"), as_of)
    aged = cells.withColumns(
        {
            "open_age_sum": F.when(F.col("is_open") == 1, F.col("open_requests") * age),
            "open_age_known": F.when((F.col("is_open") == 1) & age.isNotNull(), F.col("open_requests")).otherwise(0),
            "age_bucket": F.when(F.col("is_open") == 1, times.age_bucket(age)),
        }
    )
    members = " ".join(f"WHEN '{g}' THEN array({', '.join(map(kpis.scope_member, scopes))})" for g, scopes in _SCOPES.items())
    spread = aged.selectExpr(*kpis.TALLIES, f"{DAYS} AS _days", f"inline(CASE grain {members} END)").filter(
        # undated rows are on no day, closed rows have no age, and a key that the records lack is null
        "CASE scope WHEN 'all' THEN true WHEN 'created_day' THEN created_day IS NOT NULL"
        " WHEN 'agency_complaint_type' THEN first_key IS NOT NULL AND second_key IS NOT NULL ELSE first_key IS NOT NULL END"
    )
    days = F.when(F.col("scope").isin("created_day", "age_bucket"), None).otherwise(F.col("_days"))
    return kpis.scopes_of(spread.withColumn(DAYS, days.cast("int")).drop("_days"))


def cube_of_cells(cells: DataFrame, as_of: str | date | Column | None = None, limits: kpis.Limits = kpis.Limits()) -> DataFrame:
    """``kpi_cube`` of the records that the cells stand for."""
    return kpis.cube_of_scopes(scopes_of_cells(cells, as_of), limits)


# --- sketches ----------------------------------------------------------------------------


def sketch_states(rows: DataFrame, keys: Sequence[str], value: str = DAYS, size: int = SKETCH_SIZE) -> DataFrame:
    """Per key: how many rows, and the state of a quantile sketch of ``value``; nulls are not in it."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(size)).alias("sketch")
    )


def merge_sketches(states: DataFrame, keys: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """States of several tables as one state per key."""
    return states.groupBy(*keys).agg(
        F.sum("total_requests").alias("total_requests"), F.kll_merge_agg_bigint("sketch", F.lit(size)).alias("sketch")
    )


def sketched_quantiles(states: DataFrame) -> DataFrame:
    """The states with median and 90 % quantile in place of the sketch; null without values."""
    known = F.kll_sketch_get_n_bigint("sketch") > 0
    quantiles = {
        name: F.when(known, F.kll_sketch_get_quantile_bigint("sketch", F.lit(share))).cast("double")
        for share, name in ((0.5, "median_resolution_time"), (0.9, "p90_resolution_time"))
    }
    return states.withColumns(quantiles).drop("sketch")
