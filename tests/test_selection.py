from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caseflow.operators import selection
from caseflow.sources import windows

KIND = "k long, name string, part double, price decimal(9,2), day date, at timestamp_ntz, flag boolean, list array<int>, id long"


def _table(n=4000):
    """Few values per column, so that ties reach the last one; NULLs, NaN and repeated rows."""
    rng = random.Random(5)

    def some(values, nulls=0.1):
        return None if rng.random() < nulls else rng.choice(values)

    rows = [
        (
            some([1, 1, 1, 2, 10**15]),
            some(["", "a", "ab", "b", "\u00e9", "\U0001f600"]),
            some([0.5, -1.0, float("inf"), float("nan")]),
            some([Decimal("1.10"), Decimal("-2.00")]),
            some([date(2024, 5, d) for d in (1, 2, 3)]),
            some([datetime(2024, 5, 1, 0, 0, 0, m) for m in (0, 1, 500)]),
            some([True, False]),
            some([[1], [1, 2], []]),
            i // 2,
        )
        for i in range(n)
    ]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_table(), KIND).repartition(5).cache()


@pytest.mark.parametrize("ties", [["id"], ["name", "part", "price"], ["flag", "day", "at", "name"], ["list", "id"], []])
@pytest.mark.parametrize("limit", [1, 700, 3990])
def test_first_rows_by_any_types(table, ties, limit):
    """The same keys as a plain sort, however far the cut is narrowed."""
    by = [F.col("k").asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    want = [str(r) for r in table.orderBy(*by).select("k", *ties).limit(limit).collect()]
    found = selection.smallest_rows(table, F.col("k"), ties, limit, settle=1 if limit > 1 else 100)
    assert [str(r) for r in found.select("k", *ties).collect()] == want
    assert found.columns == table.columns


def test_limits_beyond_the_table_and_no_rows(table):
    assert selection.smallest_rows(table, F.col("k"), ["id"], 4000).count() == 4000
    assert selection.smallest_rows(table, F.col("k"), ["id"], 10**9, ordered=False).count() == 4000
    assert selection.smallest_rows(table.filter("id < 0"), F.col("k"), ["id"], 5).count() == 0


def test_rows_that_are_the_same(spark):
    df = spark.range(3000, numPartitions=6).selectExpr("1L AS k", "'x' AS name")
    found = selection.smallest_rows(df, F.col("k"), ["name"], 1234, settle=10)
    assert found.collect() == df.limit(1234).collect()


def _rows_read_by_tasks(spark, first_job):
    """Rows that each task read from shuffles, in the stages of the jobs from ``first_job`` on."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs, read = store.jobsList(None), []
    for i in range(jobs.size()):
        if jobs.apply(i).jobId() < first_job:
            continue
        stages = jobs.apply(i).stageIds()
        for s in range(stages.size()):
            tasks = store.taskList(stages.apply(s), 0, 10_000)
            for t in range(tasks.size()):
                metrics = tasks.apply(t).taskMetrics()
                if metrics.isDefined():
                    read.append(metrics.get().shuffleReadMetrics().recordsRead())
    return read


def test_no_task_sees_more_than_its_share(spark):
    """All 200,000 rows share one second, and the limit is a tenth of them."""
    n, limit, buckets = 200_000, 20_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(0, n, numPartitions=12).selectExpr(
        "timestamp_ntz'2024-05-06 00:00:00' AS at", f"(id * 7919) % {n} AS id", "'r' || id AS text"
    )
    store = spark.sparkContext._jsc.sc().statusStore()
    first_job = store.jobsList(None).size()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scan = windows.window_scan(df, "at", date(2024, 5, 6), date(2024, 5, 6), limit, ["id"])
        found = [r["id"] for r in scan.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == list(range(limit))
    read = _rows_read_by_tasks(spark, first_job)
    histogram = 12 * 2 * (selection.PIVOTS + 1)
    assert limit // buckets // 2 < max(read) <= 2 * limit // buckets + histogram


def test_large_limits_of_windows(spark):
    """Hit and fallback with a limit above the bound of the small scan, by brute force."""
    start = datetime(2026, 1, 1)
    rows = [(i % 9000, start + timedelta(minutes=i % 4000)) for i in range(30_000)] + [(i, None) for i in range(7)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz").repartition(6).cache()
    limit, day = windows.SPREAD_FROM + 1, date(2026, 1, 1)
    inside = sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0]))[:limit]
    hit = windows.window_scan_or_latest(df, "ts", day, date(2026, 1, 31), limit)
    assert [tuple(r) for r in hit.collect()] == inside
    latest = sorted((r for r in rows if r[1]), key=lambda r: (-(r[1] - start).total_seconds(), r[0]))[:limit]
    miss = windows.window_scan_or_latest(df, "ts", date(2030, 1, 1), date(2030, 1, 2), limit)
    assert [tuple(r) for r in miss.collect()] == latest
