from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caseflow.functions import report_json
from caseflow.operators import frames
from caseflow.plans import queries
from caseflow.sources import records, snapshots, windows
from tests.records import FIELDS, SCHEMA_STATUS, UNTIDY, may


def _objects():
    return [dict(zip((*FIELDS, "status"), r)) for r in UNTIDY]


def test_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(_objects()))
    df = records.read_records(spark, str(tmp_path / "a.json"))
    assert df.count() == 5 and set(df.columns) == {*FIELDS, "status"}


def test_array_files_are_compressed(spark, tmp_path, monkeypatch):
    """Names are in every record, so the arrays take a small share of their text."""
    raw = spark.range(0, 6000, numPartitions=3).selectExpr("cast(id AS string) AS unique_key", "if(id % 3 = 0, NULL, 'agency ' || id % 7) AS agency")
    monkeypatch.setattr(queries.views, "raw_requests", lambda *_: raw)
    monkeypatch.setattr(queries.snapshots, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(queries, "ROWS_PER_ARRAY", 1500)
    assert sorted(map(str, queries.array_scan(spark, "").collect())) == sorted(map(str, raw.collect()))
    parts = list(tmp_path.glob("arrays_*/file=*/part-*"))
    text = sum(len(r["value"]) for r in spark.read.text([str(p) for p in parts]).collect())
    assert len(parts) == 4 and 2 * sum(p.stat().st_size for p in parts) < text


def test_line_file(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text("\n".join(json.dumps({**o, "n": 1}) for o in _objects()))
    df = records.read_records(spark, str(tmp_path / "a.ndjson"), "ndjson")
    assert df.count() == 5
    # values stay text
    assert dict(df.dtypes)["n"] == "string"


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="Unsupported file type"):
        records.read_records(spark, "x", "csv")


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame(UNTIDY, SCHEMA_STATUS).withColumns(
        {"created_ts": F.lit("2024-05-01 00:00:00.123456").cast("timestamp_ntz"), "zoned": F.lit("2024-05-01 07:08:09.000001").cast("timestamp"), "never": F.lit(None).cast("int")}
    )
    path = snapshots.write_snapshot(df, snapshots.snapshot_path(str(tmp_path), "processed"), partitions=3)
    back = snapshots.read_snapshot(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="exists"):
        snapshots.write_snapshot(df, path)


def test_snapshot_is_compressed_in_bounded_parts(spark, tmp_path):
    """Names are in every record, so the parts take a small share of their text."""
    df = spark.range(0, 30_000, numPartitions=2).selectExpr("id", "if(id % 3 = 0, NULL, 'agency ' || id % 7) AS agency", "date_add(date'2024-05-06', cast(id % 90 AS int)) AS day")
    sizes = {}
    for name, options in (("plain", {"compression": "none"}), ("packed", {}), ("bounded", {"max_records": 4000})):
        path = snapshots.write_snapshot(df, str(tmp_path / name), **options)
        sizes[name] = [p.stat().st_size for p in (tmp_path / name).glob("part-*")]
        back = snapshots.read_snapshot(spark, path, df.schema)
        assert back.count() == 30_000 and back.exceptAll(df).isEmpty()
        lines = records.read_records(spark, path, "ndjson")
        assert lines.count() == 30_000 and set(lines.columns) == {"id", "agency", "day"}
    assert 3 * sum(sizes["packed"]) < sum(sizes["plain"])
    assert len(sizes["packed"]) == 2 and len(sizes["bounded"]) == 2 * 4


def test_snapshot_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA_STATUS)
    path = snapshots.write_snapshot(df, str(tmp_path / "none"))
    assert snapshots.read_snapshot(spark, path, df.schema).collect() == []


def test_snapshot_name():
    name = snapshots.snapshot_path("base/", "raw", datetime(2026, 1, 2, 3, 4, 5))
    assert name.startswith("base/raw_20260102_030405_")


def test_failed_snapshot_is_a_warning(spark, tmp_path):
    df = spark.createDataFrame(UNTIDY, SCHEMA_STATUS)
    (tmp_path / "taken").mkdir()
    with pytest.warns(UserWarning, match="snapshot not written"):
        assert snapshots.try_write_snapshot(df, str(tmp_path / "taken")) is None
    assert snapshots.try_write_snapshot(df, None) is None


@pytest.mark.parametrize(
    ("start", "end", "want"),
    [
        ("2026-01-10", "2026-01-01", ("2026-01-01", "2026-01-10")),
        ("2026-01-01T10:00:00Z", "2026-01-05T00:00:00", ("2026-01-01", "2026-01-05")),
        ("2026-01-01", "2036-01-01", ("2026-01-01", "2026-02-01")),
        ("2036-01-10", "2036-01-01", ("2026-02-01", "2026-02-01")),
    ],
)
def test_windows(spark, start, end, want):
    as_of = date(2026, 2, 1)
    assert tuple(map(str, windows.window_days(start, end, as_of))) == want
    low, high = windows.normalize_window(F.lit(start), F.lit(end), F.lit(as_of))
    assert tuple(map(str, spark.range(1).select(low, high).first())) == want


def test_default_window():
    assert windows.window_days(as_of=date(2026, 1, 31)) == (date(2026, 1, 1), date(2026, 1, 31))


@pytest.fixture(scope="module")
def log(spark):
    """Rows every 7 minutes, a third of all at one moment, some without a time."""
    start = datetime(2026, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i)) for i in range(600)]
    rows += [(1000 + i, datetime(2026, 1, 2, 12)) for i in range(300)]
    rows += [(5000 + i, None) for i in range(5)]
    return spark.createDataFrame(rows, "id bigint, ts timestamp_ntz").repartition(5).cache()


def _brute(log, first, last, limit, down=False):
    rows = [(r["id"], r["ts"]) for r in log.collect()]
    if first:
        rows = [r for r in rows if r[1] and first <= r[1] <= last]
    rows.sort(key=lambda r: (r[1] is None, (-1 if down else 1) * (r[1].timestamp() if r[1] else 0), r[0]))
    return rows[:limit] if limit else rows


@pytest.mark.parametrize("limit", [0, None, 1, 10, 299, 500, 2000])
def test_window_scan(log, limit):
    day = date(2026, 1, 2)
    got = windows.window_scan(log, "ts", day, day + timedelta(days=1), limit, ["id"]).collect()
    assert [tuple(r) for r in got] == _brute(log, datetime(2026, 1, 2), datetime(2026, 1, 3, 23, 59, 59), limit)


@pytest.mark.parametrize("limit", [0, 10, 500, 903, 2000])
def test_empty_window_gives_the_latest_rows(log, limit):
    day = date(2030, 1, 1)
    got = windows.window_scan_or_latest(log, "ts", day, day, limit, ["id"]).collect()
    assert [tuple(r) for r in got] == _brute(log, None, None, limit, down=True)
    filled = windows.window_scan_or_latest(log, "ts", date(2026, 1, 2), date(2026, 1, 2), limit, ["id"]).collect()
    assert [tuple(r) for r in filled] == _brute(log, datetime(2026, 1, 2), datetime(2026, 1, 2, 23, 59, 59), limit)


def test_window_ends_at_the_last_whole_second(spark):
    moments = ["2026-01-01 23:59:59", "2026-01-01 23:59:59.5", "2026-01-02 00:00:00", "2025-12-31 23:59:59"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").select(F.col("m").cast("timestamp_ntz").alias("ts"))
    got = windows.window_scan(df, "ts", date(2026, 1, 1), date(2026, 1, 1)).collect()
    assert [r["ts"] for r in got] == [datetime(2026, 1, 1, 23, 59, 59)]


EDGES = [
    ("a", "2024-05-06"), ("b", "2024-05-06 08:00:00"), ("c", "2024-05-07T23:59:59"), ("d", "2024-05-07 23:59:59"),
    ("e", "2024-05-08"), ("f", "2024-05-05T23:59:59"), ("g", "2024-05-07"), ("h", "2024-05-0x"), ("i", None),
]


@pytest.mark.parametrize("kind", ["string", "timestamp", "timestamp_ntz"])
def test_window_of_any_type(spark, kind):
    df = spark.createDataFrame(EDGES, "id string, at string").withColumn("at", F.expr(f"try_cast(at AS {kind})"))
    got = windows.window_scan(df, "at", date(2024, 5, 6), date(2024, 5, 7)).collect()
    assert [r["id"] for r in got] == ["a", "b", "g", "c", "d"] or [r["id"] for r in got] == ["a", "b", "g", "d", "c"]
    days = df.withColumn("at", F.expr("try_cast(at AS date)"))
    assert {r["id"] for r in windows.window_scan(days, "at", date(2024, 5, 6), date(2024, 5, 7)).collect()} == set("abcdg")


def test_text_window_in_own_formats(spark):
    rows = [("a", "06/05/2024"), ("b", "07/06/2024"), ("c", "07/05/2024"), ("d", "2024-05-06")]
    df = spark.createDataFrame(rows, "id string, at string")
    got = windows.window_scan(df, "at", date(2024, 5, 1), date(2024, 5, 31), formats=("dd/MM/yyyy",)).collect()
    assert [r["id"] for r in got] == ["a", "c"]
    fraction = spark.createDataFrame([("a", "2024-05-06T23:59:59.000"), ("b", "2024-05-06T23:59:59.500")], "id string, at string")
    got = windows.window_scan(fraction, "at", date(2024, 5, 6), date(2024, 5, 6), formats=("yyyy-MM-dd'T'HH:mm:ss.SSS",)).collect()
    assert [r["id"] for r in got] == ["a"]


def test_all_rows_in_one_hour(spark):
    """A third of the table shares one moment: ties go by all columns, and no task gets all rows."""
    df = spark.range(0, 30_000, numPartitions=12).selectExpr("timestamp_ntz'2024-05-06 00:00:00' AS at", "30000 - id AS id")
    scan = windows.window_scan(df, "at", date(2024, 5, 6), date(2024, 5, 6), 50)
    assert [r["id"] for r in scan.collect()] == list(range(1, 51))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def _scanned_rows(df) -> int:
    """Rows that came out of the file scans of a frame that has run."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            nodes.append(node.plan())
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "rows")
    rows = spark.range(80_000).selectExpr(
        "id", "timestampadd(MINUTE, cast(id AS int), timestamp'2024-01-01 00:00:00') AS at"
    ).withColumns({"at_ntz": F.col("at").cast("timestamp_ntz"), "day": F.to_date("at")})
    rows.repartitionByRange(8, "id").sortWithinPartitions("id").write.option("parquet.block.size", 1 << 16).partitionBy("day").parquet(path)
    flat = path + "-flat"
    with_micros = "spark.sql.parquet.outputTimestampType"
    spark.conf.set(with_micros, "TIMESTAMP_MICROS")
    rows.drop("day").repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(flat)
    spark.conf.unset(with_micros)
    return spark.read.parquet(path), spark.read.parquet(flat)


def test_hit_reads_the_window_and_miss_the_table(many_files):
    _, flat = many_files
    hit = windows.window_scan_or_latest(flat, "at", date(2024, 1, 3), date(2024, 1, 4))
    assert len(hit.collect()) == 2 * 1440
    assert _scanned_rows(hit) < 60_000
    miss = windows.window_scan_or_latest(flat, "at", date(2030, 1, 3), date(2030, 1, 4), 5)
    assert [r["id"] for r in miss.collect()] == [79_999, 79_998, 79_997, 79_996, 79_995]


def test_day_column_prunes_for_every_type(many_files):
    days, _ = many_files
    for column in ("at", "at_ntz"):
        scan = windows.window_scan(days, column, date(2024, 1, 3), date(2024, 1, 4), day_column="day")
        assert len(scan.collect()) == 2 * 1440 and _scanned_rows(scan) == 2 * 2 * 1440  # sorting samples first
        fallback = windows.window_scan_or_latest(days, column, date(2024, 1, 3), date(2024, 1, 4), day_column="day")
        assert len(fallback.collect()) == 2 * 1440 and _scanned_rows(fallback) <= 8 * 1440


def test_rows_by_day(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2024, 5, 6)), (2, date(2024, 5, 7))], "id int, created_day date")
    back = snapshots.write_rows(df, str(tmp_path / "rows"), "created_day")
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())
    assert (tmp_path / "rows" / "created_day=2024-05-07").exists()


def test_report_json(spark):
    schema = (
        "name string, day date, moment timestamp_ntz, whole decimal(10,2), part decimal(10,2), none string,"
        " nested struct<amount:decimal(5,1), days:array<date>>, counts map<int,decimal(3,1)>"
    )
    row = (
        "x", date(2026, 1, 2), datetime(2026, 1, 2, 3, 4, 5, 600), Decimal("5.00"), Decimal("5.25"), None,
        (Decimal("2.0"), [date(2026, 1, 3)]), {1: Decimal("1.5")},
    )
    df = spark.createDataFrame([row], schema)
    assert json.loads(report_json.report_json(df).first()[0]) == {
        "name": "x", "day": "2026-01-02", "moment": "2026-01-02T03:04:05.000600", "whole": 5, "part": 5.25,
        "none": None, "nested": {"amount": 2, "days": ["2026-01-03"]}, "counts": {"1": 1.5},
    }
    assert "none" not in json.loads(report_json.report_json(df, keep_nulls=False).first()[0])


def test_sorted_set(spark):
    df = spark.createDataFrame([([3, 10, 2, 3],)], "v array<int>")
    assert df.select(report_json.sorted_set(F.col("v"))).first()[0] == [10, 2, 3]


def test_frames(spark):
    df = spark.createDataFrame(UNTIDY, SCHEMA_STATUS)
    assert sorted(r[0] for r in frames.distinct_values(df, "agency").collect()) == ["PARKS", "ROADS", "WATER"]
    grouped = frames.group_by(df, ["agency"], {"unique_key": "count"}).collect()
    assert sorted(tuple(r) for r in grouped) == [("PARKS", 2), ("ROADS", 1), ("WATER", 2)]
    assert frames.group_by(df, ["agency"]).count() == 3
    assert frames.row_count(df).first()[0] == 5


def test_half_written_snapshots_are_not_read(spark, tmp_path):
    df = spark.range(100).repartition(4).selectExpr("id", "if(id = 77, raise_error('lost'), 'x') AS text")
    with pytest.warns(UserWarning, match="snapshot not written"):
        assert snapshots.try_write_snapshot(df, str(tmp_path / "half")) is None
    assert not snapshots.is_published(spark, str(tmp_path / "half")) and not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="no finished snapshot"):
        snapshots.read_snapshot(spark, str(tmp_path / "half"), df.schema)
    path = snapshots.write_snapshot(df.where("id < 50"), str(tmp_path / "deep" / "whole"))
    assert snapshots.read_snapshot(spark, path, df.schema).count() == 50
    next((tmp_path / "deep" / "whole").glob("part-*")).unlink()  # a part that went missing
    with pytest.raises(ValueError, match="no finished snapshot"):
        snapshots.read_snapshot(spark, path, df.schema)


def test_a_window_without_order_is_not_sorted(spark):
    df = spark.range(200, numPartitions=5).selectExpr("timestampadd(MINUTE, cast(id AS int), timestamp_ntz'2024-05-06 00:00:00') AS at", "id")
    day = date(2024, 5, 6)
    for scan in (windows.window_scan, windows.window_scan_or_latest):
        free, sorted_rows = scan(df, "at", day, day, ordered=False), scan(df, "at", day, day)
        assert sorted(free.collect()) == sorted_rows.collect()
        assert "rangepartitioning" not in free._jdf.queryExecution().executedPlan().toString()
        assert scan(df, "at", day, day, 3, ordered=False).count() == 3
