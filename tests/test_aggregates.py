"""Aggregates and their state are replaced together or not at all; snapshots pin the facts of their day."""

import pytest
from pyspark.sql import functions as F

from beaconry.operators import aggregates as a
from beaconry.operators import derive, worklists

NOW = "2024-01-02T12:00:00Z"


def counts(spark, n):
    return spark.createDataFrame([("scope", "account", "account", n)], "dimension string, key string, label string, n bigint")


def read(spark, folder, basis="b", filters="x", now=NOW):
    out = a.served(spark, folder, lambda: counts(spark, -1), filters, basis, now).first()
    return out["n"], out["reason"], out["as_of"]


def test_the_pair_is_replaced_whole(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "agg")
    assert read(spark, folder) == (-1, "missing", NOW)
    a.replace(counts(spark, 1), folder, "2024-01-02T01:00:00Z", "x", "b")
    assert read(spark, folder) == (1, "", "2024-01-02T01:00:00Z")
    a.replace(counts(spark, 2), folder, "2024-01-02T02:00:00+00:00", "x", "c")
    assert read(spark, folder) == (-1, "basis changed", NOW)
    assert read(spark, folder, "c") == (2, "", "2024-01-02T02:00:00+00:00")

    def crash(*_):
        raise RuntimeError("between the two writes")

    with monkeypatch.context() as m:
        m.setattr(a, "pointed", crash)
        with pytest.raises(RuntimeError):
            a.replace(counts(spark, 3), folder, "2024-01-02T03:00:00Z", "x", "d")
    assert read(spark, folder, "c") == (2, "", "2024-01-02T02:00:00+00:00")
    a.replace(counts(spark, 4), folder, "2024-01-02T04:00:00Z", "x", None)
    assert read(spark, folder, None)[:2] == (4, "") and read(spark, folder, "c")[1] == "basis changed"


@pytest.mark.parametrize(("stamp", "reason"), [("2024-01-01T10:00:00Z", ""), ("2024-01-01T09:59:00Z", "expired"), ("2024-01-02T12:00:01Z", "expired"), ("2024-01-02T01:00:00", "unreadable"), ("soon", "unreadable"), (None, "unreadable")])
def test_stamps(spark, tmp_path, stamp, reason):
    a.replace(counts(spark, 1), str(tmp_path), stamp, "x", "b")
    assert read(spark, str(tmp_path))[1] == reason
    assert read(spark, str(tmp_path), filters="y")[1] == "filter mismatch"


def test_only_one_side_is_planned(spark, tmp_path):
    a.replace(counts(spark, 1), str(tmp_path), "2024-01-02T01:00:00Z", "x", "b")

    def never():
        raise AssertionError("live work while the store is fresh")

    assert a.served(spark, str(tmp_path), never, "x", "b", NOW).count() == 1
    state = spark.createDataFrame([("2024-01-02T01:00:00Z", "x", "b")], "as_of string, filters string, basis string")
    live = spark.range(3).select(F.raise_error(F.lit("live work")).alias("n"))
    assert [r["reason"] for r in worklists.read_or_recomputed(state, live, spark.range(1).select(F.lit("s").alias("n")), "x", "b", NOW).collect()] == [""]


def test_fingerprints(spark):
    signals = spark.createDataFrame([("a",), ("a",), (None,), ("b\"",)], "status string")
    edits = spark.createDataFrame([], "edit_id bigint")
    assert a.fingerprint(signals, edits).first()["basis"] == '{"max_tier_edit":null,"status_counts":{"":1,"a":2,"b\\"":1}}'
    assert a.fingerprint(signals.limit(0), spark.range(5).toDF("edit_id")).first()["basis"] == '{"max_tier_edit":4,"status_counts":{}}'


def test_an_empty_store_is_probed(spark):
    events = spark.createDataFrame([], "source_id string, event_date string")
    signals = spark.createDataFrame([], "trigger_id string, signal_scope string, tier string, entity_id bigint")
    none = spark.createDataFrame([], "disposition string, edit_id bigint")
    assert a.probe(events, signals, none, none, "x").collect() == []
    got = a.probe(spark.createDataFrame([(None, ""), ("x", "2024-01-02"), ("x", "")], "source_id string, event_date string"), signals, none, none, "x").collect()
    assert sorted(tuple(r)[:2] + tuple(r)[4:] for r in got) == [("source", "(null)", 1, None, None), ("source", "x", 2, None, "2024-01-02"), ("window", "x", 2, "2024-01-02", "2024-01-02")]


FACTS = "fact_id string, family string, segment string, price_note string, valid_from string"


def test_facts_of_a_day(spark):
    bar = derive.NOT_AVAILABLE
    facts = [("f1", "a", "gcc_high", bar + "yet", None), ("f1", "a", "gcc_high", "sold", "2024-02-01"), ("f2", "a", "commercial", bar + "odd", "2024-01-10"), ("f3", "b", None, None, "2024-01-01"), ("f3", None, None, None, "2024-03-01"), ("f0", "a", "gcc_high", bar + "first", "2024-01-15")]
    days = [("a", d) for d in (None, "2024-01-09", "2024-01-10", "2024-01-31", "2024-02-01")] + [("b", "2023-12-31"), ("b", "2024-02-29"), ("b", "2024-03-01"), ("c", "2024-01-01"), ("a", "2024-01-10")]
    got = {(r["family"], r["day"]): (r["fact_ids"], r["caution"]) for r in derive.facts_as_of(spark.createDataFrame(days, "family string, day string"), spark.createDataFrame(facts, FACTS)).collect()}
    assert got == {
        ("a", None): (["f1"], bar + "yet"), ("a", "2024-01-09"): (["f1"], bar + "yet"), ("a", "2024-01-10"): (["f1", "f2"], bar + "yet"), ("a", "2024-01-31"): (["f0", "f1", "f2"], bar + "first"),
        ("a", "2024-02-01"): (["f0", "f1", "f2"], bar + "first"), ("b", "2023-12-31"): (None, None), ("b", "2024-02-29"): (["f3"], None), ("b", "2024-03-01"): (None, None), ("c", "2024-01-01"): (None, None),
    }


def test_snapshots(spark):
    signals = spark.createDataFrame(
        [("s1", "e1", "account", "t", "H", "2024-01-01", True, "2024-02-02"), ("s2", "e2", "sector", "t", "", None, True, "2024-02-02"), ("s3", None, "sector", "t", "H", "2024-01-01", None, None), ("s4", "e9", "parent", "t", "H", "", True, "2024-02-02"), ("s5", "e1", "account", "none", "H", "", True, "")],
        "signal_id string, entity_id string, signal_scope string, trigger_id string, headline string, event_date string, allowed boolean, made_on string",
    )
    plays = spark.createDataFrame([("p1", "t", "sec_copilot", "Go", "Ready?"), ("p2", "t", "other", None, None)], "play_id string, trigger_id string, family string, recommended_path string, discovery_question string")
    products = spark.createDataFrame([("sec_copilot", "Copilot")], "family string, name string")
    entities = spark.createDataFrame([("e1", "dod", None), ("e2", None, "possible")], "entity_id string, tenant string, likelihood string")
    facts = spark.createDataFrame([("f1", "sec_copilot", "gcc_high", derive.NOT_AVAILABLE + "x", None)], FACTS)
    existing = spark.createDataFrame([("s2", "p2"), ("s2", "p2")], "signal_id string, play_id string")
    out = {(r["signal_id"], r["play_id"]): tuple(r)[2:] for r in derive.pinned_snapshots(signals, plays, products, entities, facts, existing).collect()}
    assert len(out) == 8
    assert out["s1", "p1"] == ("suppressed", None, None, None) and out["s2", "p2"] == ("existing", None, None, None)
    assert out["s1", "p2"] == ("new", [], "Recommended path: \nDiscovery: ", derive.TO_ACCOUNT % "")
    shown = "Recommended path: Go\nDiscovery: Ready?"
    assert out["s2", "p1"] == ("new", ["f1"], f"{shown}\n{derive.CAUTION % ('Copilot', derive.NOT_AVAILABLE + 'x')}", derive.TO_SECTOR % (derive.NO_HEADLINE, "Copilot", "Ready?"))
    assert out["s3", "p1"] == ("new", ["f1"], shown, derive.UNVERIFIED)
    assert out["s4", "p1"][3] == derive.TO_SECTOR % ("H", "Copilot", "Ready?") and out["s4", "p2"][3] == derive.TO_SECTOR % ("H", "other", "")


def test_days_between_two_turns_share_their_facts(spark):
    days = spark.range(300).select(F.lit("a").alias("family"), F.date_format(F.expr("date_add(DATE '2001-01-01', CAST(id AS INT))"), "yyyy-MM-dd").alias("day"))
    facts = spark.createDataFrame([(f"f{i}", "a", None, None, v) for i in range(4) for v in (None, "2001-03-01")], "fact_id string, family string, segment string, price_note string, valid_from string")
    asked, pinned = derive.fact_periods(days, facts, ",")
    assert asked.count() == 300 and {r["_since"]: r["fact_ids"] for r in pinned.collect()} == dict.fromkeys(("", "2001-03-01"), "f0,f1,f2,f3")


def _snapshots_of_one_family(spark):
    """400 signals of one trigger on four days and none, with its two plays: one of a family with two periods of facts, one of a family without facts."""
    day = F.element_at(F.array(F.lit("2024-01-01"), F.lit("2024-02-01"), F.lit("2024-02-02"), F.lit("2024-03-01"), F.lit(None)), (F.col("id") % 5 + 1).cast("int"))
    signals = spark.range(400).select(
        F.format_string("s%d", "id").alias("signal_id"), F.lit(None).cast("string").alias("entity_id"), F.lit("sector").alias("signal_scope"), F.lit("t").alias("trigger_id"),
        F.lit("H").alias("headline"), F.lit("").alias("event_date"), F.lit(True).alias("allowed"), day.alias("made_on"),
    )
    plays = spark.createDataFrame([("p1", "t", "a", "", ""), ("p2", "t", "none", "", "")], "play_id string, trigger_id string, family string, recommended_path string, discovery_question string")
    facts = spark.createDataFrame([("f1", "a", None, None, "2024-01-15"), ("f2", "a", None, None, "2024-02-02")], FACTS)
    existing = signals.where("signal_id = 's7'").select("signal_id", F.lit("p1").alias("play_id"))
    none = spark.createDataFrame([], "entity_id string, tenant string, likelihood string")
    return derive.pinned_snapshots(signals, plays, spark.createDataFrame([], "family string, name string"), none, facts, existing, sep=",")


def test_rows_of_one_family_make_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(derive, "ROWS_A_TASK", 50, raising=False)
    tasks = [r["count"] for r in _snapshots_of_one_family(spark).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 800 and len(tasks) >= 10 and max(tasks) <= 150


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_lists_too_long_to_be_sent_give_the_same_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(derive, "LISTS_SENT", sent)
    monkeypatch.setattr(derive, "DAYS_SENT", sent)
    monkeypatch.setattr(derive, "ROWS_A_TASK", 50)
    got = {(r["signal_id"], r["play_id"]): r["fact_ids"] for r in _snapshots_of_one_family(spark).collect()}
    want = {(f"s{i}", "p1"): ["", "f1", "f1,f2", "f1,f2", ""][i % 5] for i in range(400)} | {(f"s{i}", "p2"): "" for i in range(400)}
    assert got == want | {("s7", "p1"): None}
