from __future__ import annotations

import random
from statistics import mean

import pytest
from pyspark.sql import functions as F

from caseflow.operators import features, kpis
from tests.records import SCHEMA_STATUS, UNTIDY, WEEK, may

AS_OF = "2024-06-20"


@pytest.fixture(scope="module")
def rows(spark):
    return kpis.measures(features.add_features(spark.createDataFrame(WEEK, SCHEMA_STATUS)), AS_OF).cache()


def test_summary(rows):
    s = kpis.summary(rows).first()
    assert (s["total_requests"], s["open_requests"], s["closed_requests"]) == (7, 2, 5)
    assert s["open_rate"] == pytest.approx(2 / 7) and s["closed_rate"] == pytest.approx(5 / 7)
    assert (s["avg_resolution_time"], s["median_resolution_time"], s["p90_resolution_time"]) == (3.6, 2.0, 9.0)
    assert (s["sla_breach_count"], s["sla_breach_rate"], s["sla_compliance_rate"]) == (2, 0.4, 0.6)
    assert s["ses_score"] == pytest.approx(0.3 * 5 / 7 + 0.4 * 0.6 + 0.3 / 4.6) and s["ses_band"] == "needs_attention"


def test_summary_of_no_rows(rows):
    s = kpis.summary(rows.limit(0)).first()
    assert (s["total_requests"], s["open_rate"], s["avg_resolution_time"], s["sla_compliance_rate"]) == (0, 0.0, 0.0, 1.0)
    # nothing observed counts as full speed
    assert s["ses_score"] == pytest.approx(1.0) and s["ses_band"] == "healthy"
    pack = kpis.kpi_pack(kpis.kpi_cube(rows.limit(0))).first()
    assert tuple(pack[c] for c in kpis.SUMMARY_COLUMNS) == tuple(s)
    assert pack["time_trends"] == [] and pack["complaint_type_impact_top"] == []


def test_malformed_close_counts_as_open(spark):
    untidy = kpis.measures(features.add_features(spark.createDataFrame(UNTIDY, SCHEMA_STATUS)), AS_OF)
    s = kpis.summary(untidy).first()
    assert (s["total_requests"], s["open_requests"], s["closed_requests"]) == (5, 2, 3)


def test_top_lists_are_bounded_and_break_ties_by_name(rows):
    assert [r["complaint_type"] for r in kpis.top_types(rows, 2).collect()] == ["Pothole", "Fallen Tree"]
    assert [r["agency"] for r in kpis.top_agencies(rows, 2).collect()] == ["ROADS", "PARKS"]
    assert [r["borough"] for r in kpis.borough_performance(rows, 2).collect()] == ["HARBOUR", "NORTH SHORE"]
    assert len(kpis.agency_types(rows, 3).collect()) == 3
    assert [tuple(r) for r in kpis.status_breakdown(rows).collect()] == [("Done", 5), ("Waiting", 2)]


def test_impact(rows):
    types = {r["complaint_type"]: r for r in kpis.top_types(rows).collect()}
    figures = {t: (r["avg_resolution_time"], r["sla_breach_rate"], round(r["impact_score"], 4)) for t, r in types.items()}
    assert figures == {"Fallen Tree": (4.0, 0.5, 0.5714), "Leak": (0.0, 0.0, 0.0), "Pothole": (5.0, 0.5, 1.0714)}
    assert {t: round(r["volume_share"], 6) for t, r in types.items()} == {"Fallen Tree": 0.285714, "Leak": 0.285714, "Pothole": 0.428571}
    # the ranking sees the largest types only
    ranked = kpis.type_impact(kpis.top_types(rows, 2)).collect()
    assert [r["complaint_type"] for r in ranked] == ["Pothole", "Fallen Tree"]


def test_trend_keeps_the_latest_days_in_order(rows):
    trend = kpis.daily_trend(rows, 2).collect()
    assert [(str(r["created_day"]), r["volume"], r["open_requests"]) for r in trend] == [("2024-05-08", 2, 1), ("2024-05-09", 1, 0)]


def test_group_without_observed_sla(spark):
    df = spark.createDataFrame([("1", may(13), may(14), None, None, None, None, None)], SCHEMA_STATUS)
    only = kpis.top_agencies(kpis.measures(features.add_features(df), AS_OF)).first()
    assert (only["agency"], only["sla_breach_rate"], only["sla_compliance_rate"]) == ("Unknown", 0.0, 1.0)
    assert (only["avg_resolution_time"], only["median_resolution_time"]) == (0.0, 0.0)


def test_backlog(rows, spark):
    assert [tuple(r) for r in kpis.backlog_ageing(rows).collect()] == [("31-90d", 2, 43.5)]
    undated = spark.createDataFrame([("1", "bad", None, None, "A", "B", "C", "D")], SCHEMA_STATUS)
    measured = kpis.measures(features.add_features(undated), AS_OF)
    assert [tuple(r) for r in kpis.backlog_ageing(measured).collect()] == [("unknown", 1, 0.0)]


def test_missing_segment_columns_report_nothing(rows):
    bare = rows.drop("complaint_type", "borough", "status")
    assert kpis.top_types(bare).collect() == []
    assert kpis.borough_performance(bare).collect() == []
    pack = kpis.kpi_pack(kpis.kpi_cube(bare)).first()
    assert pack["top_complaint_types"] == [] and pack["complaint_type_impact_top"] == []
    assert pack["borough_stats"] == [] and pack["status_breakdown"] == []
    assert [a["agency"] for a in pack["top_agencies"]] == ["ROADS", "PARKS", "WATER"]


def test_backfill(spark):
    raw = spark.createDataFrame(WEEK, SCHEMA_STATUS)
    done = kpis.backfill(raw.drop("closed_date")).first()
    assert done["closed_ts"] is None and done["resolution_time_days"] is None and done["sla_breach"] is None
    full = kpis.backfill(raw).orderBy("unique_key").collect()
    assert [r["resolution_time_days"] for r in full] == [2, 6, None, 0, 9, None, 1]
    nothing = kpis.summary(kpis.measures(raw.select("agency"), AS_OF)).first()
    assert (nothing["total_requests"], nothing["open_requests"]) == (7, 7)


def test_sla_is_required(spark):
    with pytest.raises(ValueError, match="sla_breach"):
        kpis.require_sla(spark.createDataFrame(WEEK, SCHEMA_STATUS))


def test_pack(rows):
    pack = kpis.kpi_pack(kpis.kpi_cube(rows, kpis.Limits(2, 2, 3))).first().asDict(recursive=True)
    assert pack["volume"] == {"total_requests": 7, "open_requests": 2, "closed_requests": 5, "open_rate": 2 / 7, "closed_rate": 5 / 7}
    assert pack["sla"] == {"breach_count": 2, "breach_rate": 0.4, "compliance_rate": 0.6, "observed_count": 5}
    assert pack["resolution"] == {"avg_resolution_time": 3.6, "median_resolution_time": 2.0, "p90_resolution_time": 9.0}
    sizes = [len(pack[n]) for n in ("time_trends", "top_complaint_types", "top_agencies", "borough_performance", "agency_category_performance")]
    assert sizes == [2, 2, 2, 2, 3]
    assert [str(d["created_day"]) for d in pack["time_trends"]] == ["2024-05-08", "2024-05-09"]
    assert [t["complaint_type"] for t in pack["complaint_type_impact_top"]] == ["Pothole", "Fallen Tree"]
    assert pack["borough_stats"] == pack["borough_performance"]


def _same(left, right):
    def plain(df):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]

    assert plain(left) == plain(right)


@pytest.fixture(scope="module")
def many(spark):
    """Skewed records: one agency and one type hold a third and more of the rows."""
    chance = random.Random(11)
    data = []
    for i in range(4000):
        hot = chance.random() < 0.4
        created = chance.randint(1, 28)
        closed = None if chance.random() < 0.3 else min(28, max(1, created + chance.randint(-2, 9)))
        data.append((
            str(i), may(created) if chance.random() < 0.95 else "bad", may(min(28, created + 3)),
            may(closed), "HOT" if hot else chance.choice(["A", "B", None]),
            "HOT" if hot else f"T{chance.randint(1, 30)}", chance.choice(["N", "S", None]), chance.choice(["Open", "Closed"]),
        ))
    df = spark.createDataFrame(data, SCHEMA_STATUS).repartition(5)
    return kpis.measures(features.add_features(df), "2024-06-10").cache()


def test_cube_equals_the_single_reports(many):
    limits = kpis.Limits(5, 7, 9)
    cube = kpis.kpi_cube(many, limits).cache()

    def of(scope):
        return cube.filter(F.col("scope") == scope).orderBy("report_rank")

    _same(of("all").select(*kpis.SUMMARY_COLUMNS), kpis.summary(many))
    _same(of("agency").select(*kpis.AGENCY_COLUMNS), kpis.top_agencies(many, 5))
    _same(of("borough").select(*kpis.BOROUGH_COLUMNS), kpis.borough_performance(many, 5))
    _same(of("status").select(*kpis.STATUS_COLUMNS), kpis.status_breakdown(many, 5))
    _same(of("agency_complaint_type").select(*kpis.PAIR_COLUMNS), kpis.agency_types(many, 9))
    _same(of("age_bucket").select("age_bucket", "open_requests", "avg_age_days"), kpis.backlog_ageing(many))
    _same(of("created_day").orderBy("created_day").select(*kpis.TREND_COLUMNS), kpis.daily_trend(many, 7))
    types = kpis.top_types(many, 5)
    _same(of("complaint_type").select("complaint_type", *kpis.SEGMENT_COLUMNS), types.select("complaint_type", *kpis.SEGMENT_COLUMNS))


def test_segments_against_brute_force(many):
    groups = {}
    for r in many.select("agency", "complaint_type", "resolution_time_days", "sla_breach_int", "is_open").collect():
        groups.setdefault((r["agency"], r["complaint_type"]), []).append(r)
    got = {(r["agency"], r["complaint_type"]): r for r in kpis.segment_kpis(many, ["agency", "complaint_type"]).collect()}
    assert got.keys() == groups.keys()
    for key, members in groups.items():
        days = sorted(m["resolution_time_days"] for m in members if m["resolution_time_days"] is not None)
        breach = [m["sla_breach_int"] for m in members if m["sla_breach_int"] is not None]
        figures = got[key]
        assert figures["total_requests"] == len(members)
        assert figures["open_requests"] == sum(m["is_open"] for m in members)
        assert figures["avg_resolution_time"] == pytest.approx(mean(days) if days else 0.0)
        assert figures["sla_breach_rate"] == pytest.approx(mean(breach) if breach else 0.0)
        for share, name in ((5, "median_resolution_time"), (9, "p90_resolution_time")):
            # smallest value whose rank reaches the share
            place = -(-share * len(days) // 10) - 1
            assert figures[name] == (days[max(place, 0)] if days else 0.0)


def test_approximate_quantiles_stay_within_their_rank_error(many):
    exact = sorted(r[0] for r in many.select("resolution_time_days").dropna().collect())
    s = kpis.summary(many, quantiles="approx").first()
    for share, name in ((0.5, "median_resolution_time"), (0.9, "p90_resolution_time")):
        below = sum(d < s[name] for d in exact) / len(exact)
        upto = sum(d <= s[name] for d in exact) / len(exact)
        assert below - 1e-3 <= share <= upto + 1e-3
