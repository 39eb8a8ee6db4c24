"""Narratives checked against evidence, one contradiction at a time."""

import json

import pytest
from pyspark.sql import functions as F

from gridlake.operators import evidence

SCHEMA = (
    "pack int, insight_id string, rule_id string, category string, subject_id string, comparison_subject_id string, "
    "metric string, direction string, magnitude double, unit string, evidence_strength string, sample_size int, "
    "traceability struct<source_metric:string,source_function:string,rule_id:string,rule_parameters:map<string,double>,"
    "observed_value:double,unit:string,sample_size:int,minimum_sample_size:int,sign_convention:string,"
    "season_year:bigint,round_num:int,driver_id:string,constructor_id:string,rounds_included:array<int>,"
    "excluded_observations:int>, explanation string"
)


def insight(metric, direction, rule="LONGITUDINAL_X", other=None, magnitude=0.8, size=5, rounds=(1, 2, 3, 4, 5, 6), excluded=1):
    trail = ("m", "f", rule, {}, magnitude, "u", size, 3, "s", 2024, None, "ann", "red", list(rounds), excluded)
    return (1, f"{rule}:1", rule, "TEAMMATE", "ann", other, metric, direction, magnitude, "u", "HIGH", size, trail, "text")


def verdict(spark, text, *insights):
    raw = json.dumps({"narrative": text, "limitations": [], "evidence_references": ["a"]})
    return check(spark, raw, *insights)


def check(spark, raw, *insights):
    facts = spark.createDataFrame(list(insights) or [insight("x", "stable")], SCHEMA)
    told = spark.createDataFrame([(1, raw)], "pack int, raw string")
    return evidence.check_narratives(told, facts, ["pack"]).first()


CASES = [
    ("Ann was clearly slower than Bob.", insight("q", "faster", other="bob"), "says slower, evidence says faster"),
    ("Ann was faster than Bob.", insight("q", "faster", other="bob"), None),
    ("ann lost positions again", insight("c", "gained", excluded=0), "says positions lost, evidence says gained"),
    ("ann moved up a lot", insight("c", "lost", excluded=0), "says positions gained, evidence says lost"),
    ("ann had no DNFs", insight("c", "stable"), "says all races finished, evidence excludes some"),
    ("they finished all 6 rounds", insight("c", "stable"), "says all races finished, evidence excludes some"),
    ("ann had no DNFs", insight("c", "stable", excluded=0), None),
    ("ann won 3 of 5", insight("race_win_rate", "higher"), "states a wrong win ratio"),
    ("ann won 4 out of 5", insight("race_win_rate", "higher"), None),
    ("ann won 3 of 7", insight("race_win_rate", "higher"), None),
    ("the record is 2-3", insight("race_win_rate", "higher"), "states a wrong score"),
    ("the record is 4 - 1", insight("race_win_rate", "higher"), None),
    ("a mean across 3 valid finishes", insight("f", "higher", rule="LONGITUDINAL_RECENT_FORM", excluded=0),
     "states a wrong number of finishes"),
    ("a mean across 5 valid finishes", insight("f", "higher", rule="LONGITUDINAL_RECENT_FORM", excluded=0), None),
]


@pytest.mark.parametrize("text, fact, reason", CASES)
def test_contradictions(spark, text, fact, reason):
    row = verdict(spark, text, fact)
    assert (row.reason, row.status) == (reason, "unavailable" if reason else "ok")


@pytest.mark.parametrize(
    "raw, reason",
    [
        (None, "empty response"),
        ("  ", "empty response"),
        ("{", "not valid JSON"),
        ("[1]", "not a JSON object"),
        ('{"narrative": 3, "limitations": [], "evidence_references": []}', "narrative is not a non-empty string"),
        ('{"narrative": " ", "limitations": [], "evidence_references": []}', "narrative is not a non-empty string"),
        ('{"narrative": "a", "evidence_references": []}', "limitations is not a list"),
        ('{"narrative": "a", "limitations": [], "evidence_references": "b"}', "evidence_references is not a list"),
        ('```json\n{"narrative": "a", "limitations": ["l"], "evidence_references": []}\n```', None),
    ],
)
def test_form(spark, raw, reason):
    assert check(spark, raw).reason == reason


def test_first_contradiction_wins(spark):
    facts = [insight("c", "gained", rule="B", excluded=0), insight("c", "lost", rule="A", excluded=0)]
    row = verdict(spark, "ann lost positions, then ann moved up", *facts)
    assert row.contradicted_insight == "A:1"


def test_later_insights_are_not_evidence(spark):
    many = [insight("c", "stable", rule=f"R{i:02d}", excluded=0) for i in range(10)]
    late = insight("c", "gained", rule="Z", excluded=0)
    assert verdict(spark, "ann lost positions", *many, late).status == "ok"
    package = evidence.evidence_packages(spark.createDataFrame([*many, late], SCHEMA), ["pack"]).first()
    assert package.insights == 10


def test_narratives_of_one_package_are_judged_one_by_one(spark):
    facts = spark.createDataFrame([insight("c", "gained", excluded=0)], SCHEMA)
    body = '{"narrative": "%s", "limitations": [], "evidence_references": []}'
    told = [(1, 1, body % "all fine"), (1, 2, body % "ann lost positions"), (1, 3, body % "ann lost positions")]
    rows = spark.createDataFrame(told, "pack int, n int, raw string")
    for key in ("n", None):
        found = evidence.check_narratives(rows, facts, ["pack"], narrative_id=key).collect()
        assert sorted((r.narrative, r.status) for r in found) == [("all fine", "ok")] + [("ann lost positions", "unavailable")] * 2
