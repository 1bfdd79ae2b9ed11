"""Breakdowns, relevance, whole evidence and inactive entities on known rows."""

import json

import pytest
from pyspark.sql import functions as F

from beaconry.operators import enrich, measure, resolve, rules, scoring

SCORES = "id int, score double, score_base double, score_decay double, score_account_fit double, score_scope_fit double, score_combo double"


def test_breakdowns(spark):
    rows = [(1, 1.5, 5.0, 0.5, 0.6, 1.0, None), (2, 10.0, 4.0, 1.0, 2.0, 1.0, 1.25), (3, None, 4.0, 1.0, 1.0, 1.0, None), (4, 1.0, 4.0, None, 1.0, 1.0, None), (5, 0.0, 0.0, 0.5, 1.0, 1.0, None), (6, 1.0, None, 1.0, 1.0, 1.0, None), (7, 1.0, 3.0, None, None, 0.5, None)]
    got = {r["id"]: (r["breakdown"], r["ceiling"]) for r in scoring.score_breakdown(spark.createDataFrame(rows, SCORES)).collect()}
    assert got == {
        1: ("score 1.5 = 5 × 0.50 × 0.60 × 1.00 · no combo applied", 3.0), 2: ("score 10 = 4 × 1.00 × 2.00 × 1.00 × 1.25", 10.0), 3: (None, 4.0), 4: (None, 4.0),
        5: ("score 0 = 0 × 0.50 × 1.00 × 1.00 · no combo applied", None), 6: (None, None), 7: (None, 1.5),
    }
    assert [r[0] for r in spark.createDataFrame([(None,), (100.0,), (2.504,), (0.1,)], "s double").select(scoring.shown_score(F.col("s"))).collect()] == ["unscored", "100", "2.5", "0.1"]


def test_relevance(spark):
    doc = lambda **x: json.dumps({"agency_names": ["Transportation Security Administration"], "title": "Pipeline security directive"} | x)
    rows = [
        ("in", "2024-01-01", doc()), ("late", "2023-12-31", doc()), ("undated", None, doc()), ("undated", "2024-1-1", doc()), ("no", "2024-01-01", doc(title="Pipeline")), ("no", "2024-01-01", doc(title="security directive")),
        ("no", "2024-01-01", doc(agency_names="Energy")), ("in", "2024-05-05", doc(agency_names="transportation SECURITY administration", title=None, abstract="LNG", action="Cybersecurity")), ("bad", "2024-01-01", "{"), ("bad", "2024-01-01", "[]"),
        ("bad", "2024-01-01", "5"), ("no", None, None), ("no", "2024-01-01", ""),
    ]
    df = spark.createDataFrame([("s", *r[1:]) for r in rows], "source string, event_date string, payload string")
    got = measure.relevance(df, "source", "2024-01-01").first()
    assert tuple(got) == ("s", 13, 3, 2, 1, 2, "reuse")
    assert measure.relevance(df.where("event_date = '2023-12-31'"), "source", "2024-01-01").first()["recommendation"] == "widen"
    assert measure.relevance(df.limit(0), "source", "2024-01-01").collect() == []


@pytest.mark.parametrize("active", [True, False, None])
def test_inactive_entities_take_no_part(spark, active):
    entities = spark.createDataFrame([("e1", "Norwind", "7", "", "", active)], "entity_id string, name string, cik string, ticker string, lei string, active boolean")
    aliases = spark.createDataFrame([("e1", "North Wind")], "entity_id string, alias string")
    collisions = spark.createDataFrame([], "entity_id string, term string")
    events = spark.createDataFrame([(1, "7", None, None, None, None), (2, None, None, None, "north wind", None), (3, None, None, None, "Norwinds", None)], "event_id long, cik string, ticker string, lei string, name string, context string")
    got = {r["event_id"]: r["entity_id"] for r in resolve.resolved(events, entities, aliases, collisions).collect()}
    assert got == dict.fromkeys((1, 2, 3), "e1" if active else None)


def test_blank_details_of_a_case_are_not_cited(spark):
    cases = spark.createDataFrame([("r1", "", 5, "Warning Letter", "Acme", None, " ", "49 CFR 1")], "raw_event_id string, event_date string, case_id int, case_type string, operator string, opened string, violation_category string, cited_regulations string")
    found = spark.createDataFrame([("r1", "matched", "e1", 1.0)], "raw_event_id string, status string, entity_id string, confidence double")
    out = rules.pipeline_cases(cases, found, spark.createDataFrame([("e1", "e1")], "entity_id string, top string"), spark.createDataFrame([("e1", "lng")], "entity_id string, subsector string"), rules.SEVERITIES)
    assert list(out.first()["evidence"]) == ["CPF 5: Warning Letter against Acme", "Cited regulations: 49 CFR 1", rules.SEVERITIES["Warning Letter"]]


def test_lists_are_edited_in_order(spark):
    rows = spark.createDataFrame([("e1", "seeded", "seed"), ("e1", "own", "operator"), ("gone", "x", "operator")], "entity_id string, alias string, origin string")
    entities = spark.createDataFrame([("e1",), ("e1",)], "entity_id string")
    edits = [
        (1, "add", "e1", " new "), (2, "add", "e1", "new"), (3, "remove", "e1", "new"), (4, "remove", "e1", "new"), (5, "add", "e1", "new"), (6, "remove", "e1", "seeded"), (7, "remove", "e1", "own"), (8, "add", "e1", "own"), (9, "add", "e9", "a"),
        (10, "add", "e1", None), (11, "edit", "e1", "own"), (12, None, "e1", "own"), (13, "remove", "gone", "x"), (14, "add", "e1", "seeded"), (15, "remove", "e1", "seeded"), (16, "remove", None, None), (17, "add", None, "b"),
    ]
    after, audit = enrich.listed_edits(rows, spark.createDataFrame(edits, "seq int, action string, entity_id string, alias string"), entities, "alias")
    assert [r["outcome"] for r in audit.orderBy("seq").collect()] == ["added", "exists", "removed", "unknown", "added", "not_operator", "removed", "added", "unknown_entity", "blank", "bad_action", "bad_action", "removed", "exists", "not_operator", "unknown", "unknown_entity"]
    assert sorted(map(tuple, after.collect())) == [("e1", "new", "operator"), ("e1", "own", "operator"), ("e1", "seeded", "seed")]
    assert {r["seq"]: (r["old_value"], r["new_value"]) for r in audit.collect() if r["seq"] in (1, 3, 6)} == {1: (None, "new"), 3: ("new", None), 6: (None, None)}


def test_cards_have_their_parts_in_order(spark):
    signals = spark.createDataFrame([("s1",), ("s2",)], "signal_id string")
    evidence = spark.createDataFrame([("s1", 2, 1, "r", "late", "x", "1"), ("s1", 1, 2, "r", "second", None, "1"), ("s1", 1, 1, "r", "first", "x", None), ("s9", 1, 1, "r", "x", "x", "1")], "signal_id string, rank int, n int, raw_event_id string, text string, locator string, version string")
    snapshots = spark.createDataFrame([("s1", "p2", '["f2","f1","f1","f9"]', "d", "t", "o"), ("s1", "p1", "no list", "d", "t", "o"), ("s1", "p3", '["f1"]', "d", "t", "o"), ("s2", "p2", None, None, None, None)], "signal_id string, play_id string, fact_ids string, made_on string, display_text string, outreach_safe_text string")
    candidates = spark.createDataFrame([("p1", "a", "A", "q"), ("p2", "b", None, None)], "play_id string, family string, recommended_path string, discovery_question string")
    products = spark.createDataFrame([("a", "Alpha")], "family string, name string")
    facts = spark.createDataFrame([("f1", "a", "s", "A", "u", 5.0), ("f2", "a", "s", "A", "u", 6.0)], "fact_id string, family string, segment string, source_quality string, source_url string, price_note double")
    out = enrich.card_details(signals, evidence, snapshots, candidates, products, facts)
    assert "price" not in out.schema.simpleString()
    got = {r["signal_id"]: r for r in out.collect()}
    assert [e["text"] for e in got["s1"]["evidence"]] == ["first", "second", "late"] and got["s2"]["evidence"] == []
    assert [(p["play_id"], p["product"], [f["fact_id"] for f in p["facts"]]) for p in got["s1"]["snapshots"]] == [("p1", "Alpha", []), ("p2", "b", ["f1", "f2"])]
    assert [(p["play_id"], p["facts"]) for p in got["s2"]["snapshots"]] == [("p2", [])]


def test_disagreements_come_newest_first(spark):
    judged = spark.createDataFrame([("a", 1, "useful", True), ("b", 0, "not_useful", True), ("c", 0, "useful", False), ("d", 1, "useful", True), ("gone", 1, "useful", True)], "signal_id string, judge_negative int, verdict string, disagree boolean")
    signals = spark.createDataFrame([("a", "H", "2024-01-01", "account", "active", "e", "t", "r"), ("b", "H", "2024-02-01", "account", "active", None, "x", None), ("d", "H", None, "account", "active", "e", "t", "r")], "signal_id string, headline string, event_date string, signal_scope string, status string, entity_id string, trigger_id string, raw_event_id string")
    one = lambda key, value, column: spark.createDataFrame([(key, value)], column)
    out = enrich.disagreement_list(judged, signals, one("e", "Acme", "entity_id string, name string"), one("t", "T", "trigger_id string, name string"), one("r", "src", "raw_event_id string, source_id string")).collect()
    assert [(r["signal_id"], r["entity_name"], r["trigger_name"], r["source_id"]) for r in out] == [("b", None, None, None), ("a", "Acme", "T", "src"), ("gone", None, None, None), ("d", "Acme", "T", "src")]


def test_decisions_are_logged_for_matches_only(spark):
    entities = spark.createDataFrame([("e1", "Norwind Inc.", "7", "NW", ""), ("e2", "Sudwind", "", "", "L2"), ("e3", "Sudwind", "", "", "")], "entity_id string, name string, cik string, ticker string, lei string")
    none = spark.createDataFrame([], "entity_id string, alias string")
    events = spark.createDataFrame([(1, " 007", None, None, None, None), (2, None, None, None, "NORWIND, Corp", None), (3, None, None, None, "Sudwind", None), (4, None, None, None, "Nobody", None), (5, None, "nw", None, "x", None)], "event_id long, cik string, ticker string, lei string, name string, context string")
    found = resolve.resolved(events, entities, none, none.withColumnRenamed("alias", "term"))
    log = {r["event_id"]: r for r in resolve.decision_log(found, events, "1.0", "classification", "2024-01-01T00:00:00Z").collect()}
    assert {i: (r["entity_id"], r["method"], r["matched_terms"]) for i, r in log.items()} == {1: ("e1", "cik", '["007"]'), 2: ("e1", "name", '["norwind"]'), 5: ("e1", "ticker", '["nw"]')}
    assert {(r["decision"], r["decided_by"], r["rejected_terms"], r["version"]) for r in log.values()} == {("auto", "classification", "[]", "1.0")}
