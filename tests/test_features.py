from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from caseflow import fixed_values as fixed
from caseflow.functions.times import parse_timestamp
from caseflow.operators import features, kpis
from tests.records import SCHEMA_STATUS, UNTIDY, may

TIMES = "unique_key string, created_date string, due_date string, closed_date string"


@pytest.mark.parametrize(
    ("created", "due", "closed", "breach"),
    [
        (may(13, "09:30:00"), may(14, "09:30:00"), may(14, "09:30:01"), 1),
        (may(13, "09:30:00"), may(14, "09:30:00"), may(14, "09:30:00"), 0),
        (may(13, "09:30:00"), may(27), may(13, "09:30:00"), 0),
        (may(13, "09:30:00"), may(13, "09:30:00"), may(30), 1),
        (may(13, "09:30:00"), may(13, "09:29:59"), may(14), None),
        (may(13, "09:30:00"), may(14), may(13, "09:29:59"), None),
        ("13 May", may(14), may(15), None),
        (None, may(14, "11:00:00"), may(21), None),
        (may(13), None, may(21, "05:00:00"), None),
        (may(13, "22:00:00"), may(14), None, None),
    ],
)
def test_sla_breach(spark, created, due, closed, breach):
    df = spark.createDataFrame([("1", created, due, closed)], TIMES)
    assert features.add_features(df).first()["sla_breach"] == breach


def test_parse_failed_flags(spark):
    df = spark.createDataFrame([("1", may(3), "later", may(4)), ("2", "?", may(4), None)], TIMES)
    flags = [f"{t}_ts_parse_failed" for t in ("created", "due", "closed")]
    rows = features.add_times(df).orderBy("unique_key").select(*flags).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 0), (1, 0, 0)]


def test_all_default_formats(spark):
    rows = (
        features.add_features(spark.createDataFrame(UNTIDY, SCHEMA_STATUS))
        .orderBy("unique_key")
        .select("sla_breach", "closed_ts_parse_failed", "resolution_time_days", "resolution_completed")
        .collect()
    )
    assert [tuple(r) for r in rows] == [(0, 0, 0, 1), (1, 0, 3, 1), (None, 0, None, 0), (None, 1, None, 0), (0, 0, 2, 1)]


def test_features_keep_negative_days_and_measures_clamp_them(spark):
    df = spark.createDataFrame([("1", may(17), may(18), may(11)), ("2", may(17), may(18), None)], TIMES)
    done = features.add_features(df)
    assert [r[0] for r in done.orderBy("unique_key").select("resolution_time_days").collect()] == [-6, None]
    rows = kpis.measures(done, "2024-06-20").orderBy("unique_key").collect()
    assert [r["resolution_time_days"] for r in rows] == [0, None]


@pytest.mark.parametrize(
    ("as_of", "bucket"),
    [("2024-05-10", "0-7d"), ("2024-05-11", "8-30d"), ("2024-06-02", "8-30d"),
     ("2024-06-03", "31-90d"), ("2024-08-01", "31-90d"), ("2024-08-02", "90d+"), ("2024-01-01", "0-7d")],
)
def test_age_bucket_borders(spark, as_of, bucket):
    df = spark.createDataFrame([("1", may(3, "18:00:00"), None, None)], TIMES)
    assert kpis.measures(df, as_of).first()["age_bucket"] == bucket


def test_age_unknown_and_closed(spark):
    df = spark.createDataFrame([("1", "?", None, None), ("2", may(3), None, may(4))], TIMES)
    rows = kpis.measures(df, "2024-06-20").orderBy("unique_key").collect()
    assert [r["age_bucket"] for r in rows] == ["unknown", None]


def _plain(raw, formats):
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats]).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "formats",
    [
        fixed.TIMESTAMP_FORMATS,
        ("yyyy-MM-dd",),
        ("yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy/MM/dd"),
        ("dd/MM/yyyy", "yyyy-MM-dd HH:mm"),
    ],
)
def test_format_guards_change_nothing(spark, formats):
    """Texts near the formats: guarded parsing equals trying every format."""
    seeds = [
        "2026-01-01T00:00:00", "2026-01-01 00:00:00", "2026-01-01", "+12345-01-01", "-2026-01-01",
        "0000-01-01", "2026-02-30", "2026-01-01t00:00:00", "2026-13-01", "2026-01-01T24:00:00",
        "2026-1-1", "2026/01/02", "03/04/2026", "2026-01-01 10:11", "2026-01-01T01:02:03.456", "",
    ]
    chance = random.Random(7)
    texts = set(seeds)
    for _ in range(3000):
        text = list(chance.choice(seeds) or "x")
        i = chance.randrange(len(text))
        text[i : i + chance.randint(0, 1)] = chance.choice("0123456789-:T t+/. ")
        text = "".join(text)
        # plain parsing overflows on years beyond a timestamp
        if not (text[:1] in "+-" and len(text.lstrip("+-").split("-")[0]) > 5) and not text[:6].isdigit():
            texts.add(text)
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "raw string")
    got = df.select(
        "raw",
        parse_timestamp(F.col("raw"), formats).cast("string").alias("guarded"),
        _plain(F.col("raw"), formats).cast("string").alias("plain"),
    )
    assert got.filter("plain IS NOT NULL").count() > 10
    assert got.filter("NOT guarded <=> plain").collect() == []


def test_years_out_of_range_are_malformed(spark):
    df = spark.createDataFrame([("+999999-01-01",), ("+294246-12-31",), ("-999999-01-01",)], "raw string")
    got = df.select(parse_timestamp(F.col("raw")).cast("string").alias("t")).collect()
    assert [r["t"] for r in got] == [None, "+294246-12-31 00:00:00", None]


def test_no_formats_means_the_default_parser(spark):
    df = spark.createDataFrame([("2026-01-01T01:02:03.5",)], "raw string")
    got = df.select(parse_timestamp(F.col("raw"), ()).cast("string").alias("t")).first()["t"]
    assert got == "2026-01-01 01:02:03.5"


def test_row_level_steps_work_on_a_stream(spark, tmp_path):
    """They hold no state and run no action, so a streaming frame takes them too."""
    df = spark.createDataFrame(UNTIDY, SCHEMA_STATUS)
    df.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    rows = kpis.measures(features.add_features(stream), "2024-06-20")
    query = (
        rows.writeStream.format("memory").queryName("measured").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.table("measured").selectExpr("sum(is_open)").first()[0] == 2


def test_typed_dates_are_taken_as_they_are(spark):
    df = spark.range(1).selectExpr(
        "'k' AS unique_key", "timestamp_ntz'2024-05-13 01:02:03.5' AS created_date", "date'2024-05-14' AS due_date",
        "timestamp'2024-05-13 23:00:00.123456' AS closed_date",
    )
    r = features.add_features(df).selectExpr("*", "cast(closed_ts AS string) AS c", "cast(created_ts AS string) AS o").first()
    assert (r["o"], r["c"]) == ("2024-05-13 01:02:03.5", "2024-05-13 23:00:00.123456")
    assert (r["created_ts_parse_failed"], r["due_ts_parse_failed"], r["closed_ts_parse_failed"]) == (0, 0, 0)
    assert (r["sla_breach"], r["resolution_time_days"]) == (0, 0)
