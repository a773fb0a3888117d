from __future__ import annotations

import json
from datetime import date

import pytest

from caseflow.operators import kpis
from caseflow.plans import analysis
from caseflow.sources import snapshots
from tests.records import FIELDS, SCHEMA_STATUS, UNTIDY, WEEK

AS_OF = "2024-06-20"


def test_whole_run(spark):
    run = analysis.analyse(spark.createDataFrame(WEEK, SCHEMA_STATUS), AS_OF)
    assert run.verdict.first()["is_valid"]
    assert run.records.count() == 7 and run.snapshot is None
    assert run.pack.first()["total_requests"] == 7
    assert "Pothole" in run.insights.first()["signals"]["priority_complaint_types"]
    ids = [r["id"] for r in run.actions.collect()]
    assert ids == sorted(ids) and "REC-002" in ids


def test_invalid_table_stops_everything(spark):
    run = analysis.analyse(spark.createDataFrame(UNTIDY, SCHEMA_STATUS), AS_OF)
    assert not run.verdict.first()["is_valid"]
    for frame in (run.records, run.pack, run.insights, run.actions):
        assert frame.count() == 0


def test_gate_can_be_left_open(spark):
    run = analysis.analyse(spark.createDataFrame(UNTIDY, SCHEMA_STATUS), AS_OF, gated=False)
    assert run.pack.first()["total_requests"] == 5 and run.actions.count() > 0


def test_missing_fields_stop_everything(spark):
    run = analysis.analyse(spark.createDataFrame(WEEK, SCHEMA_STATUS).drop("created_date", "agency"), AS_OF)
    assert run.verdict.first()["errors"] == ["Missing required fields: created_date, agency"]
    assert run.actions.count() == 0


def test_snapshot_feeds_the_kpis(spark, tmp_path):
    df = spark.createDataFrame(WEEK, SCHEMA_STATUS)
    plain = analysis.analyse(df, AS_OF, limits=kpis.Limits(2, 2, 3))
    saved = analysis.analyse(df, AS_OF, limits=kpis.Limits(2, 2, 3), snapshot_path=str(tmp_path / "run"))
    assert saved.snapshot and list((tmp_path / "run").glob("part-*"))
    assert saved.pack.collect() == plain.pack.collect()


def test_run_over_a_file_with_aliases(spark, tmp_path):
    names = ["uniqueKey", "created_dt", "due_dt", "closed_dt", "agency_name", "complaint", "borough_name", "status"]
    (tmp_path / "a.json").write_text(json.dumps([dict(zip(names, r)) for r in WEEK]))
    run = analysis.analyse_file(spark, str(tmp_path / "a.json"), as_of=AS_OF)
    assert run.pack.first()["total_requests"] == 7
    assert set(FIELDS) <= set(run.records.columns)


def test_run_over_a_window(spark):
    df = spark.createDataFrame(WEEK, SCHEMA_STATUS)
    run = analysis.analyse_window(df, start="2024-05-07", end="2024-05-07", as_of=date(2024, 6, 20))
    assert run.pack.first()["total_requests"] == 2
    missed = analysis.analyse_window(df, start="2023-05-07", end="2023-05-07", as_of=date(2024, 6, 20), limit=3)
    assert sorted(r["unique_key"] for r in missed.records.collect()) == ["a15", "a16", "a17"]


def test_window_over_aliased_columns_and_own_formats(spark):
    rows = [(f"k{i}", f"{i:02d}/05/2024", f"{i + 2:02d}/05/2024", None if i == 4 else f"{i + 3:02d}/05/2024", "PARKS", "Leak", "HARBOUR") for i in range(1, 9)]
    names = ["uniqueKey", "createdDate", "due_dt", "closed_dt", "agency_name", "complaint", "borough_name"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    run = analysis.analyse_window(df, start="2024-05-03", end="2024-05-06", as_of=date(2024, 6, 20), formats=("dd/MM/yyyy",))
    assert run.verdict.first()["is_valid"] and "createdDate" in run.verdict.first()["alias_resolution"]
    pack = run.pack.first()
    assert (pack["total_requests"], pack["open_requests"], pack["avg_resolution_time"]) == (4, 1, 3.0)


def test_all_rows_of_a_window_count(spark):
    rows = spark.range(30_000).selectExpr(
        "cast(id AS string) AS unique_key", "'2024-05-06T10:00:00' AS created_date", "'2024-05-07' AS due_date",
        "'2024-05-08' AS closed_date", "'PARKS' AS agency", "'Leak' AS complaint_type", "'HARBOUR' AS borough",
    )
    run = analysis.analyse_window(rows, start="2024-05-06", end="2024-05-06", as_of=date(2024, 6, 20))
    assert run.pack.first()["total_requests"] == 30_000


def test_verdict_and_rows_of_a_limited_window_agree(spark):
    """Keys repeat; which rows the limit takes is settled by all columns."""
    rows = [("k", "2024-05-06", "2024-05-08", "bad" if i % 2 else "2024-05-07", f"A{i:02d}", "Leak", "HARBOUR") for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in FIELDS)).repartition(7)
    run = analysis.analyse_window(df, start="2024-05-06", end="2024-05-06", as_of=date(2024, 6, 20), limit=20)
    assert run.verdict.first()["row_count"] == 20 and run.verdict.first()["is_valid"]


def test_snapshot_changes_no_moment(spark, tmp_path):
    rows = [(*r[:1], "2024-05-06T08:15:00.123456", *r[2:]) for r in WEEK]
    df = spark.createDataFrame(rows, SCHEMA_STATUS)
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",)
    plain = analysis.analyse(df, AS_OF, formats=formats)
    saved = analysis.analyse(df, AS_OF, formats=formats, snapshot_path=str(tmp_path / "run"))
    assert sorted(map(str, saved.records.collect())) == sorted(map(str, plain.records.collect()))


def test_a_run_over_a_window_is_not_sorted(spark):
    run = analysis.analyse_window(spark.createDataFrame(WEEK, SCHEMA_STATUS), start="2024-05-07", end="2024-05-09", as_of=date(2024, 6, 20))
    for frame in (run.records, run.pack):
        assert "rangepartitioning" not in frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def counted_file(spark, tmp_path):
    """A record file whose rows are counted whenever they are read."""
    spark.createDataFrame(WEEK, SCHEMA_STATUS).repartition(3).write.parquet(str(tmp_path / "raw"))
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(str(tmp_path / "raw"))
    return df.mapInArrow(seen, df.schema), reads


def test_a_run_with_a_snapshot_reads_its_records_once(spark, tmp_path, counted_file):
    df, reads = counted_file
    run = analysis.analyse(df, AS_OF, snapshot_path=str(tmp_path / "run"))
    verdict, pack, actions = run.verdict.first(), run.pack.collect(), run.actions.collect()
    assert run.records.count() == len(WEEK) and reads.value == len(WEEK)
    plain = analysis.analyse(df, AS_OF)
    assert (verdict, pack, actions) == (plain.verdict.first(), plain.pack.collect(), plain.actions.collect())
    assert snapshots.is_published(spark, run.snapshot) and not list(tmp_path.glob("_staging*"))


def test_records_are_counted_anew_if_a_stage_ran_again(spark, tmp_path, monkeypatch, counted_file):
    df, reads = counted_file
    monkeypatch.setattr(snapshots, "_ran_again", lambda spark, group: True)
    run = analysis.analyse(df, AS_OF, snapshot_path=str(tmp_path / "run"))
    assert run.verdict.first() == analysis.analyse(df, AS_OF).verdict.first() and run.pack.first()["total_requests"] == 7
    assert reads.value > len(WEEK)


def test_an_invalid_run_publishes_no_rows(spark, tmp_path):
    for rows, drop in ((UNTIDY, ()), (WEEK, ("agency", "created_date"))):
        base = tmp_path / f"run{len(drop)}"
        df = spark.createDataFrame(rows, SCHEMA_STATUS).drop(*drop)
        run = analysis.analyse(df, AS_OF, snapshot_path=str(base))
        assert run.verdict.first() == analysis.analyse(df, AS_OF).verdict.first() and not run.verdict.first()["is_valid"]
        assert run.records.count() == run.actions.count() == 0 and not list(tmp_path.glob("*-rows"))


def test_a_failed_write_leaves_the_run_going(spark, tmp_path):
    (tmp_path / "run-rows").mkdir()
    with pytest.warns(UserWarning, match="snapshot not written"):
        run = analysis.analyse(spark.createDataFrame(WEEK, SCHEMA_STATUS), AS_OF, snapshot_path=str(tmp_path / "run"))
    assert run.snapshot is None and run.pack.first()["total_requests"] == 7 and not list(tmp_path.glob("_staging*"))
