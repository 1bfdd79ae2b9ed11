"""Terms, boxes, page differences, roll-ups and exports at sizes and on cases where plainer ways fail."""

import difflib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from beaconry.operators import measure, page_changes, resolve, rules, state, terms


def by_pattern(text, listed):
    """Plainly: one alternation, longest first, not inside words."""
    pattern = "|".join(r"\s+".join(map(re.escape, t.split())) for t in sorted(listed, key=len, reverse=True) if t.split())
    return [m[0] for m in re.finditer(rf"(?i)(?<!\w)(?:{pattern})(?!\w)", text)] if pattern else []


@pytest.mark.parametrize(
    ("text", "listed", "found"),
    [
        ("Acme Corp. acquires Beta", ["Acme Corp."], ["Acme Corp."]),
        ("ACME  corp.,beta", ["Acme Corp.", "beta"], ["ACME  corp.", "beta"]),
        ("Acme Corp.x and Acmes", ["Acme Corp.", "Acme"], ["Acme"]),
        ("AT&T, (Yahoo!) x", ["AT&T", "(Yahoo!)", "Yahoo"], ["AT&T", "(Yahoo!)"]),
        ("x(Yahoo!)", ["(Yahoo!)", "Yahoo"], ["Yahoo"]),
        ("red widget red", ["red", "red widget"], ["red widget", "red"]),
        ("a b a b c", ["a b c", "a b"], ["a b", "a b c"]),
        ("Straße Über", ["straße", "ÜBER"], ["Straße", "Über"]),
        ("", ["a"], []), (None, ["a"], []), ("a", [], []), ("a", ["", " "], []),
    ],
)
def test_terms_found(text, listed, found):
    assert terms.found_in(text, terms.tree_of(listed)) == found
    assert text is None or by_pattern(text, listed) == found


def test_terms_against_one_alternation():
    rng = random.Random(1)
    word = lambda: rng.choice(["ab", "a", "b.", "&", "co", "Co.", "x-y", "é"])
    for _ in range(300):
        listed = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(8)]
        text = rng.choice(["", " "]).join(word() + rng.choice(["", " ", ", "]) for _ in range(30))
        assert terms.found_in(text, terms.tree_of(listed)) == by_pattern(text, listed)


def test_a_hundred_thousand_terms(spark):
    listed = [f"Firm {i} Corp." for i in range(100_000)]
    titles = spark.range(2000).select("id", F.format_string("news: firm %d corp. buys Firm %d  Corp. and firm %dcorp.", F.col("id") * 7, F.col("id") + 90_000, "id").alias("title"))
    got = {r["id"]: r["terms"] for r in measure.term_hits(titles, "id", "title", listed).collect()}
    assert got[5] == ["firm 35 corp.", "firm 90005 corp."] and len(got) == 2000


def test_deals_with_terms_that_end_in_marks(spark):
    rows = spark.createDataFrame([("r1", "Acme Corp. acquires Beta", ""), ("r2", None, "")], "raw_event_id string, title string, event_date string")
    assert [r["name_hint"] for r in rules.deals(rows, ["acme corp.", "beta"]).orderBy("name_hint").collect()] == ["Acme Corp.", "Beta"]


def test_an_odd_agency_loses_no_card(spark):
    doc = {"title": "Reliability Standard CIP-003", "abstract": "x", "type": "Rule", "effective_on": "2024-01-01", "agencies": [5, "no", None, {"slug": "federal-energy-regulatory-commission"}], "cfr_references": [7, {"title": 18, "part": "40"}], "docket_ids": None}
    rows = spark.createDataFrame([("r1", json.dumps(doc), "2024-01-01")], "raw_event_id string, payload string, event_date string")
    assert rules.regulatory_documents(rows).count() == 1
    doc["agencies"], doc["cfr_references"] = "none", 3
    rows = spark.createDataFrame([("r1", json.dumps(doc), "2024-01-01")], "raw_event_id string, payload string, event_date string")
    assert rules.regulatory_documents(rows).count() == 0


def test_repeated_resolutions_give_one_card(spark):
    listings = spark.createDataFrame([("r1", "crew", "Acme", "Energy", "2024-01-01")], "raw_event_id string, crew string, victim string, industry string, event_date string")
    found = spark.createDataFrame([("r1", "matched", 7, 0.8), ("r1", "matched", 7, 0.8), ("r1", "review", 8, 1.0), ("r1", "matched", 5, 0.8), ("r1", "matched", 4, 0.7)], "raw_event_id string, status string, entity_id long, confidence double")
    got = rules.leak_listings(listings, found).collect()
    assert [(r["trigger_id"], r["entity_id"]) for r in got] == [("own_incident", "5")]


def test_boxes_by_grid(spark):
    rng = random.Random(2)
    inf, nan = float("inf"), float("nan")
    boxes = [(f"b{i}", x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.choice([0.0, 0.5, 3.0, 64.0]), y + rng.choice([0.0, 1.0, 7.0])) for i in range(150)]
    boxes += [("all", -inf, -inf, inf, inf), ("bad", 1.0, 1.0, 0.0, 0.0), ("nan", nan, 0.0, 1.0, 1.0), ("null", None, 0.0, 1.0, 1.0), ("big", -1e6, -1e6, 1e6, 1e6), ("dot", 8.0, 8.0, 8.0, 8.0), ("dot2", 8.0, 8.0, 8.0, 8.0)]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(300)] + [(900, 8.0, 8.0), (900, 8.0, 8.0), (901, nan, 0.0), (902, None, 0.0), (903, boxes[0][1], boxes[0][2]), (904, 1e7, 0.0)]
    p, b = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(boxes, "region string, x0 double, y0 double, x1 double, y1 double")
    want = []
    for i, x, y in points:
        hits = [((x1 - x0) * (y1 - y0), r) for r, x0, y0, x1, y1 in boxes if None not in (x, x0) and x0 <= x <= x1 and y0 <= y <= y1]
        want += [(i, min(hits)[1])] if hits else []
    out = measure.located(p, b)
    assert sorted((r["id"], r["region"]) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and plan.count("NestedLoopJoin") <= 4  # but for the one row of levels, in each form of the plan


def test_many_points_and_boxes(spark):
    points = spark.range(1_000_000).select("id", (F.col("id") % 1000).cast("double").alias("x"), F.floor(F.col("id") / 1000).cast("double").alias("y"))
    boxes = spark.range(100_000).select(F.format_string("r%06d", "id").alias("region"), (F.col("id") % 1000 - 0.4).alias("x0"), (F.floor(F.col("id") / 1000) * 10 - 0.4).alias("y0"), (F.col("id") % 1000 + 0.4).alias("x1"), (F.floor(F.col("id") / 1000) * 10 + 0.4).alias("y1"))
    assert measure.located(points, boxes).count() == 100_000


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    real = resolve.checkpointed
    monkeypatch.setattr(resolve, "checkpointed", lambda df: rounds.append(1) or real(df))
    entities = spark.range(n + 10).select(F.col("id").alias("entity_id"), F.lit(None).cast("bigint").alias("parent_id"))
    edges = spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    assert {(r["entity_id"] < n, r["top"] == (0 if r["entity_id"] < n else r["entity_id"])) for r in resolve.rolled_up(entities, edges).collect()} == {(True, True), (False, True)}
    assert len(rounds) <= 17


def test_cycles_and_tails(spark):
    rng = random.Random(3)
    up = {i: rng.randrange(60) for i in range(60) if rng.random() < 0.95} | {70: 71, 71: 72, 72: 70, 73: 72, 74: 74, 75: 74, 76: 999}
    nodes = sorted({*range(60), *range(70, 77)})
    want = {}
    for i in nodes:
        seen, at = set(), i
        while at not in seen and up.get(at) in nodes:
            seen.add(at)
            at = up[at]
        want[i] = at
    entities = spark.createDataFrame([(i, None) for i in nodes], "entity_id long, parent_id long")
    edges = spark.createDataFrame([(c, p) for c, p in up.items()], "child long, parent long")
    assert dict(map(tuple, resolve.rolled_up(entities, edges).collect())) == want


def test_regions_of_texts():
    rng = random.Random(4)
    for _ in range(300):
        old = [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]
        new = list(old)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(new) + 1)
            new[i : i + rng.randrange(3)] = [rng.choice("abcxyz") for _ in range(rng.randrange(3))]
        regions = page_changes.changed_regions(old, new)
        assert all(p[1] < q[0] or p[3] < q[2] or (p[1] <= q[0] and p[3] <= q[2]) for p, q in zip(regions, regions[1:], strict=False))
        made, at = [], 0
        for a, b, c, d in regions:  # replacing the regions makes the new text of the old one
            made += old[at:a] + new[c:d]
            at = b
        assert made + old[at:] == new
    words = [f"w{i}" for i in range(40)]
    assert page_changes.changed_regions(words, words[:10] + ["x", "y"] + words[12:30] + words[31:]) == [(10, 12, 10, 12), (30, 31, 30, 30)]
    assert page_changes.changed_regions(["a", "b"] * 4, ["a", "b"] * 2 + ["x"] + ["a", "b"] * 2) == [(4, 4, 4, 5)]


def test_texts_with_few_changes_are_told_as_by_full_comparison():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    old = [rng.choice(vocabulary) for _ in range(4000)]
    new = list(old)
    for i in (3500, 2200, 2199, 900, 10):
        new[i : i + 1] = ["CIP-00" + str(i % 9), "new"]
    want = [(a, b, c, d) for kind, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if kind != "equal"]
    assert page_changes.changed_regions(old, new) == want


def test_very_long_pages_take_seconds():
    rng = random.Random(6)
    old = [f"w{rng.randrange(20_000)}" for _ in range(100_000)]
    new = old[:50_000] + ["CIP-007"] + old[50_000:90_000] + old[95_000:]
    began = time.perf_counter()
    assert [s for s, _ in page_changes.changed_standards(" ".join(old), " ".join(new))] == ["CIP-007"]
    page_changes.changed_regions(["same"] * 100_000, ["same", "other"] * 50_000)
    assert time.perf_counter() - began < 60


def test_a_torn_export_is_refused(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", [1.0, None], {"k": 1}), (None, None, None, None)], "id long, t string, v array<double>, m map<string, int>")
    folder = str(tmp_path / "export")
    with pytest.raises(ValueError, match="no whole export"):
        state.read_export(spark, folder)
    state.export_snapshot({"a": a, "b": spark.range(5), "none": a.limit(0)}, folder)
    got = state.read_export(spark, folder)
    assert {k: df.count() for k, df in got.items()} == {"a": 2, "b": 5, "none": 0} and got["a"].schema == a.schema
    spark.range(5, 10).write.mode("overwrite").parquet(f"{folder}/b")  # as many rows, other ones
    with pytest.raises(ValueError, match="table b"):
        state.read_export(spark, folder)
    broken = a.withColumn("t", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        state.export_snapshot({"b": spark.range(5), "a": broken}, folder)
    with pytest.raises(ValueError, match="no whole export"):
        state.read_export(spark, folder)
    with pytest.raises(ValueError, match="needs tables"):
        state.export_snapshot({}, folder)


def test_page_texts_reach_python_in_bounded_batches(spark):
    from beaconry.operators import page_changes

    names = [f"spark.sql.execution.arrow.{name}" for name in page_changes.BATCH]
    for name in names:
        spark.conf.unset(name)
    rows = spark.createDataFrame([("u", "d", "see CIP-001 now", "see now")], "url string, event_date string, text string, prev string")
    assert page_changes.standard_changes(rows).count() == 1
    assert [int(spark.conf.get(name)) for name in names] == [1000, 8 << 20]
