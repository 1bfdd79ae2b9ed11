"""Normalisers and text functions on awkward input."""

import json

from pyspark.sql import functions as F

from beaconry.functions import dates, text
from beaconry.operators import classify, feed, state
from beaconry.sources import normalize


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_rss_items(spark):
    rows = [
        ("a", "http://x/1", "", "Mon, 02 Feb 2026 10:00:00 -0400"), ("b", "http://x/2", "g2", "Tue, 3 Feb 26 23:30:00 +0000"), ("c", "http://x/3", None, "not a date"),
        ("d", "http://x/4", "g4", "Mon, 02 Feb 2015 10:00:00 +0000"), ("e", "http://x/5", "g5", None),
    ]
    out = normalize.rss_items(spark.createDataFrame(rows, "title string, link string, guid string, pub_date string"), "2025-01-01")
    got = {r["title"]: (r["native_id"], r["event_date"]) for r in out.collect()}
    assert got == {"a": ("http://x/1", "2026-02-02"), "b": ("g2", "2026-02-03"), "c": ("http://x/3", ""), "e": ("g5", "")}


def test_filings_are_cut_to_the_shortest_array(spark):
    payload = json.dumps({"accessionNumber": ["a", "b", "c"], "filingDate": ["2026-01-01", "2020-01-01", "2026-01-02"], "form": ["8-K", "8-K", "10-K"], "items": ["5.02, 9.01", ""], "primaryDocument": ["p", "q", "r"]})
    df = spark.createDataFrame([(1, payload), (2, "{}"), (3, "no json"), (4, None)], "entity_id int, payload string")
    got = [(r["entity_id"], r["native_id"], r["items"]) for r in normalize.filings(df, "2025-01-01").collect()]
    assert got == [(1, "a", ["5.02", "9.01"])]


def test_short_us_dates_turn_at_fifty(spark):
    for value, want in (("7/4/49", "2049-07-04"), ("7/4/50", "1950-07-04"), ("12/31/2024", "2024-12-31"), ("13/1/20", None), ("x", None), (None, None)):
        got = one(spark, value, dates.short_us_date)
        assert (None if got is None else str(got)) == want


def test_listing_keys_without_ids_do_not_mind_order(spark):
    a, b = '{"victim":"v","group":"g"}', '{"group":"g","victim":"v"}'
    rows = [(a,), (b,), ('{"id":" 7 ","victim":"w"}',)]
    got = [r["native_id"] for r in normalize.listings(spark.createDataFrame(rows, "payload string")).collect()]
    assert got[0] == got[1] and got[0].startswith("h:") and len(got[0]) == 26 and got[2] == "7"


def test_names_and_texts(spark):
    for value, want in (("Énergie & Co., Inc.", "énergie and"), ("Holdings Group", ""), ("Group One LLC", "group one"), (None, ""), ("A.B.C. Company Ltd", "a b c")):
        assert one(spark, value, text.normalized_name) == want
    assert one(spark, "A (B (C)) D, ET AL.", text.case_name) == "A D"
    assert one(spark, "<p>a &amp;amp; b</p>\n c", text.plain_text) == "a &amp; b c"
    assert one(spark, '["a; b", " c "]', text.list_cell) == ["a; b", "c"]
    assert one(spark, " x;; y ", text.list_cell) == ["x", "y"] and one(spark, None, text.list_cell) == []
    assert one(spark, "an LNG terminal", classify.is_pipeline_relevant) is True
    assert one(spark, "https://www.ransomware.live.evil.com/x", lambda c: text.identity_safe_url(c, F.lit("sector"))) == "https://www.ransomware.live.evil.com/x"
    assert one(spark, "SIEM and more", lambda c: text.terms_absent(c, ["siem"])) is False
    assert one(spark, None, text.severity_band, "double") == "low"


def test_novel_tokens_may_be_cut_short_at_the_end(spark):
    df = spark.createDataFrame([("alpha beta gam", "Alpha beta gamma"), ("alpha delta", "alpha"), ("", "x")], "a string, s string")
    got = [r[0] for r in df.select(classify.novel_tokens(F.col("a"), F.col("s"), [])).collect()]
    assert got == [[], ["delta"], []]


def test_near_pairs_like_brute_force(spark):
    rows = [(f"s{i}", i % 3, "t", f"2024-01-{1 + i * 7 % 28:02d}") for i in range(40)] + [("n", None, "t", "2024-01-01"), ("u", 1, "t", None)]
    df = spark.createDataFrame(rows, "signal_id string, entity_id int, trigger_id string, d string").withColumn("day", F.to_date("d"))
    got = {(r["a"], r["b"], r["gap"]) for r in feed.near_in_time(df, 3).collect()}
    want = set()
    for i, e, _, d in rows:
        for j, f, _, g in rows:
            if i < j and e is not None and e == f and d and g and abs(int(d[-2:]) - int(g[-2:])) <= 3:
                want.add((i, j, abs(int(d[-2:]) - int(g[-2:]))))
    assert got == want and want


def test_snapshots_are_exported(spark, tmp_path):
    folders = state.export_snapshot({"a": spark.range(3)}, str(tmp_path))
    assert [spark.read.parquet(f).count() for f in folders] == [3]
