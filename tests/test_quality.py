from __future__ import annotations

from caseflow.operators import quality, schema
from tests.records import FIELDS, SCHEMA, SCHEMA_STATUS, UNTIDY, may


def _rows(n, **changes):
    row = dict(zip(FIELDS, ("k", may(14), may(16), may(19, "10:00:00"), "ROADS", "Pothole", "HARBOUR")))
    return [tuple({**row, "unique_key": str(i), **changes}.values()) for i in range(n)]


def _verdict(df):
    _, verdict = quality.read_verdict(df)
    return verdict.first()


def test_valid(spark):
    v = _verdict(spark.createDataFrame(_rows(2), SCHEMA))
    assert v["is_valid"] and v["errors"] == [] and v["row_count"] == 2 and v["missing_fields"] == []
    assert v["required_fields"] == list(FIELDS) and v["available_fields"] == list(FIELDS)


def test_missing_column(spark):
    v = _verdict(spark.createDataFrame(_rows(2), SCHEMA).drop("closed_date", "agency"))
    assert not v["is_valid"]
    assert v["errors"] == ["Missing required fields: closed_date, agency"]
    assert v["missing_fields"] == ["closed_date", "agency"]


def test_empty(spark):
    v = _verdict(spark.createDataFrame([], SCHEMA))
    assert v["errors"] == ["Input dataset is empty."] and v["row_count"] == 0
    assert set(v["null_counts"].values()) == {0} and set(v["null_rates"].values()) == {0.0}


def test_empty_and_missing(spark):
    v = _verdict(spark.createDataFrame([], SCHEMA).drop("borough"))
    assert v["errors"] == ["Input dataset is empty.", "Missing required fields: borough"]


def test_malformed_date(spark):
    v = _verdict(spark.createDataFrame(_rows(1) + _rows(1, due_date="not-a-date"), SCHEMA))
    assert v["errors"] == ["Field 'due_date' contains 1 malformed timestamp value(s)."]
    assert v["malformed_date_counts"] == {"created_date": 0, "due_date": 1, "closed_date": 0}


def test_high_null_is_a_warning(spark):
    v = _verdict(spark.createDataFrame(_rows(1) + _rows(3, agency=None), SCHEMA))
    assert v["is_valid"] and v["high_null_fields"] == ["agency"]
    assert v["warnings"] == ["High null rate detected in 'agency' (75.0%)."]
    assert v["null_counts"]["agency"] == 3 and v["null_rates"]["agency"] == 0.75


def test_null_rate_at_the_threshold(spark):
    v = _verdict(spark.createDataFrame(_rows(1) + _rows(1, agency=None), SCHEMA))
    assert v["high_null_fields"] == ["agency"]


def test_all_null_is_an_error_and_no_warning(spark):
    v = _verdict(spark.createDataFrame(_rows(2, due_date=None), SCHEMA))
    assert v["errors"] == ["All records have null due_date."] and v["warnings"] == []


def test_missing_field_keeps_figures_at_zero(spark):
    rows = _rows(1, due_date="not-a-date", agency=None)
    v = _verdict(spark.createDataFrame(rows, SCHEMA).drop("complaint_type"))
    assert v["errors"] == ["Missing required fields: complaint_type"]
    assert set(v["malformed_date_counts"].values()) == {0} and set(v["null_counts"].values()) == {0}


def test_aliases(spark):
    names = ["uniqueKey", "created_ts", "due_ts", "closed_ts", "agency_name", "complaint_category", "borough_name"]
    df = spark.createDataFrame(_rows(2), SCHEMA).toDF(*names)
    records, verdict = quality.read_verdict(df)
    assert records.columns == list(FIELDS)
    v = verdict.first()
    assert v["is_valid"] and v["alias_resolution"] == dict(zip(names, FIELDS))
    assert v["warnings"][0] == "Accepted alias 'uniqueKey' was normalized to 'unique_key'."


def test_alias_priority_and_case():
    assert schema.alias_map(["complaint_id", "Unique Key"]) == {"Unique Key": "unique_key"}
    assert schema.alias_map(["unique_key", "uniqueKey"]) == {}
    assert schema.alias_map(["UNIQUEKEY"]) == {}


def test_untidy_rows_are_invalid(spark):
    v = _verdict(spark.createDataFrame(UNTIDY, SCHEMA_STATUS))
    assert v["errors"] == ["Field 'closed_date' contains 1 malformed timestamp value(s)."]


def test_gate(spark):
    good = spark.createDataFrame(_rows(3), SCHEMA)
    bad = spark.createDataFrame(UNTIDY, SCHEMA_STATUS)
    assert quality.gate(good, quality.verdict(good)).count() == 3
    assert quality.gate(bad, quality.verdict(bad)).count() == 0


def test_profile(spark):
    df = spark.createDataFrame(UNTIDY, SCHEMA_STATUS)
    rows = {r["column_name"]: r for r in quality.profile(df).collect()}
    assert list(rows) == df.columns
    assert rows["closed_date"]["null_count"] == 1 and rows["closed_date"]["non_null_coverage"] == 0.8
    empty = quality.profile(df.limit(0)).first()
    assert (empty["total_rows"], empty["non_null_coverage"]) == (0, None)


def test_own_formats(spark):
    rows = _rows(2, created_date="14/05/2024", due_date="16/05/2024", closed_date="20/05/2024")
    df = spark.createDataFrame(rows, SCHEMA)
    assert not _verdict(df)["is_valid"]
    assert quality.read_verdict(df, ("dd/MM/yyyy",))[1].first()["is_valid"]


def test_typed_dates_are_never_malformed(spark):
    df = spark.createDataFrame(_rows(3), SCHEMA).selectExpr(
        "unique_key", "timestamp_ntz'2024-05-14 01:02:03.5' AS created_date", "date'2024-05-16' AS due_date",
        "timestamp'2024-05-19 10:00:00.25' AS closed_date", "agency", "complaint_type", "borough",
    )
    v = _verdict(df)
    assert v["is_valid"] and set(v["malformed_date_counts"].values()) == {0}
