from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseflow import fixed_values as fixed
from caseflow.operators import actions, insights

KPI = (
    "sla_compliance_rate double, sla_breach_rate double, backlog_ratio double,"
    " avg_resolution_time double, p90_resolution_time double, ses_band string, total_requests bigint,"
    " complaint_type_impact_top array<struct<complaint_type:string>>,"
    " borough_stats array<struct<borough:string,total_requests:bigint,avg_resolution_time:double>>"
)


def _derive(spark, *values):
    return insights.derive_insights(spark.createDataFrame([values], KPI)).first()


def test_all_rules(spark):
    boroughs = [("HARBOUR", 300, 8.0), ("OLD TOWN", 400, 6.0), ("NORTH SHORE", 300, 2.0)]
    r = _derive(spark, 0.71, 0.29, 0.33, 4.5, 12.0, "critical", 1000, [("Pothole",), ("Leak",)], boroughs)
    assert [(i["rule"], i["text"]) for i in r["insights"]] == [
        ("sla_below_target", fixed.SLA_SENTENCE.format(compliance="71.0%", breach="29.0%")),
        ("backlog_elevated", fixed.BACKLOG_SENTENCE.format(backlog="33.0%")),
        ("long_tail", fixed.LONG_TAIL_SENTENCE),
        ("priority_types", fixed.TYPES_SENTENCE.format(names="Pothole, Leak")),
        ("slow_boroughs", fixed.BOROUGHS_SENTENCE.format(names="HARBOUR, OLD TOWN")),
        ("ses_alert", fixed.BAND_SENTENCE.format(band="critical")),
    ]
    assert r["signals"].asDict() == {
        "priority_complaint_types": ["Pothole", "Leak"], "priority_boroughs": ["HARBOUR", "OLD TOWN"],
    }


def test_thresholds_are_strict(spark):
    r = _derive(spark, 0.90, 0.10, 0.20, 3.0, 7.0, "watch", 10, [], [])
    assert [i["rule"] for i in r["insights"]] == ["stable"]
    assert r["signals"].asDict() == {"priority_complaint_types": [], "priority_boroughs": []}
    assert _derive(spark, 1.0, 0.0, 0.0, 0.0, 7.5, "healthy", 10, [], [])["insights"][0]["rule"] == "long_tail"


def test_five_types_and_unnamed_ones(spark):
    named = [("A",), (None,), ("C",), ("D",), ("E",), ("F",)]
    r = _derive(spark, 1.0, 0.0, 0.0, 0.0, 0.0, "healthy", 10, named, None)
    assert r["signals"]["priority_complaint_types"] == ["A", "Unknown", "C", "D", "E"]


@pytest.mark.parametrize(
    ("total", "average", "boroughs", "slow"),
    [
        # below the floor of 100 rows; exactly 1.15 times the average is not slower
        (1000, 10.0, [("A", 99, 99.0), ("B", 100, 11.5), ("C", 100, 11.6)], ["C"]),
        # the floor is half a percent of all rows once that is more
        (100_000, 10.0, [("A", 499, 99.0), ("B", 500, 99.0)], ["B"]),
        # slowest first, equal averages in the given order, at most three
        (1000, 1.0, [("A", 200, 5.0), ("B", 200, 9.0), ("C", 200, 5.0), ("D", 200, 5.0)], ["B", "A", "C"]),
        # nothing closed yet
        (1000, 0.0, [("A", 200, 5.0)], []),
    ],
)
def test_slow_boroughs(spark, total, average, boroughs, slow):
    r = _derive(spark, 1.0, 0.0, 0.0, average, 0.0, "healthy", total, [], boroughs)
    assert r["signals"]["priority_boroughs"] == slow


def test_defaults(spark):
    r = insights.derive_insights(spark.createDataFrame([(0.8,)], "sla_rate double")).first()
    assert r["insights"][0]["text"] == fixed.SLA_SENTENCE.format(compliance="80.0%", breach="20.0%")
    bare = insights.derive_insights(spark.createDataFrame([("x",)], "name string")).first()
    assert bare["insights"][0]["text"].startswith("Overall SLA compliance is 0.0% (breach rate 100.0%)")


INPUT = "insights array<string>, signals struct<priority_complaint_types:array<string>,priority_boroughs:array<string>>"
SLA = fixed.SLA_SENTENCE.format(compliance="64.5%", breach="35.5%")
BACKLOG = fixed.BACKLOG_SENTENCE.format(backlog="51.2%")
TAIL = fixed.LONG_TAIL_SENTENCE


def _recommend(spark, sentences, signals=(None, None)):
    df = spark.createDataFrame([(sentences, signals)], INPUT)
    return actions.recommend(df, []).collect()


def test_one_action_per_category_keeps_all_its_evidence(spark):
    later = fixed.SLA_SENTENCE.format(compliance="58.0%", breach="42.0%")
    got = _recommend(spark, [TAIL, SLA, TAIL, later, TAIL])
    assert [(r["id"], [e["insight_index"] for e in r["evidence"]]) for r in got] == [
        ("REC-002", [1, 3] if SLA < later else [3, 1]), ("REC-004", [0, 2, 4]),
    ]
    assert {e["evidence_strength"] for r in got for e in r["evidence"]} == {85, 70}


def test_a_signal_beside_sentences(spark):
    """One signal, a sentence for two categories, and one for none."""
    sentences = ["Nothing of note on Sunday", "Resolution time grew with the backlog"]
    got = {r["id"]: r for r in _recommend(spark, sentences, ([], ["HARBOUR"]))}
    assert {i: r["category"] for i, r in got.items()} == {
        "REC-003": "backlog_management", "REC-004": "resolution_flow", "REC-006": "borough_operations",
    }
    assert [got[i]["strongest_evidence"]["insight_index"] for i in ("REC-003", "REC-004", "REC-006")] == [1, 1, None]
    (only,) = got["REC-006"]["evidence"]
    assert (only["source"], only["signal_value"], only["evidence_strength"]) == ("signal", ["HARBOUR"], fixed.SIGNAL_STRENGTH)


def test_rules_from_a_frame(spark):
    frame = actions.rule_frame(spark)
    assert actions.rules_of(frame).actions == dict(fixed.ACTIONS)
    extra = spark.createDataFrame(
        [("weekend crews", "OWN-1", 0, "Staff the weekend", None, ["Sunday"], 50), ("backlog_management", *fixed.ACTIONS["backlog_management"], None, ["queue", "long"], 99)],
        frame.schema,
    )
    sentences = ["Queue is LONG on sunday", "The backlog grows"]
    rows = spark.createDataFrame([(1, sentences), (2, ["all quiet"])], "k int, insights array<string>")
    got = {(r["k"], r["id"]): r for r in actions.recommend(rows, ["k"], actions.rules_of(frame.union(extra))).collect()}
    assert set(got) == {(1, "OWN-1"), (1, "REC-003"), (2, "REC-900"), (2, "REC-901")}
    assert [e["evidence_strength"] for e in got[1, "REC-003"]["evidence"]] == [99, 80]
    assert got[1, "OWN-1"]["strongest_evidence"]["trigger"] == sentences[0]
    plain = actions.recommend(rows, ["k"]).collect()
    assert plain == actions.recommend(rows, ["k"], actions.rules_of(frame)).collect()


def test_rules_that_cannot_be(spark):
    frame = actions.rule_frame(spark)
    with pytest.raises(ValueError, match="more than one action"):
        actions.rules_of(frame.withColumn("id", F.concat("id", F.size("words").cast("string"))))
    with pytest.raises(ValueError, match="more than 1000"):
        actions.rules_of(frame.withColumn("words", F.explode(F.array_repeat("words", 200))))
    with pytest.raises(ValueError, match="no action for the category lost"):
        actions.Rules(keywords=[("lost", ["x"], 1)])
    with pytest.raises(ValueError, match="no words"):
        actions.Rules(keywords=[("service_recovery", [], 1)])


def test_fallback(spark):
    got = _recommend(spark, [])
    assert [(r["id"], r["category"], r["strongest_evidence"]["evidence_strength"]) for r in got] == [
        ("REC-900", "monitoring", 1), ("REC-901", "alerting", 1),
    ]
    assert [r["id"] for r in _recommend(spark, None)] == ["REC-900", "REC-901"]


def test_one_sentence_may_match_several_rules(spark):
    got = _recommend(spark, ["The BACKLOG is critical, boroughs are slower, SLA compliance unknown"])
    assert [(r["id"], r["evidence"][0]["evidence_strength"]) for r in got] == [
        ("REC-001", 100), ("REC-002", 75), ("REC-003", 80), ("REC-006", 65),
    ]


def test_equal_strength_goes_by_trigger(spark):
    got = _recommend(spark, ["z backlog", "a backlog"])
    assert [e["trigger"] for e in got[0]["evidence"]] == ["a backlog", "z backlog"]
    assert got[0]["strongest_evidence"]["insight_index"] == 1


def test_evidence_json_leaves_out_what_does_not_apply(spark):
    df = spark.createDataFrame([([BACKLOG], (None, ["HARBOUR"]))], INPUT)
    rows = actions.evidence_json(actions.recommend(df, [])).collect()
    assert rows[0]["strongest_evidence"] == (
        '{"source":"insight","trigger":"' + BACKLOG + '","evidence_strength":80,"insight_index":0}'
    )
    assert rows[1]["evidence"] == (
        '[{"source":"signal","trigger":"priority_boroughs","evidence_strength":95,'
        '"signal_key":"priority_boroughs","signal_value":["HARBOUR"]}]'
    )


def test_segments_are_handled_side_by_side(spark):
    df = spark.createDataFrame([("a", [SLA], (None, None)), ("b", [], (None, None))], "name string, " + INPUT)
    got = [(r["name"], r["id"]) for r in actions.recommend(df, ["name"]).collect()]
    assert got == [("a", "REC-002"), ("b", "REC-900"), ("b", "REC-901")]
