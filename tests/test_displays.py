"""Records as shown, on awkward rows."""

from pyspark.sql import functions as F

from beaconry.operators import displays


def test_awkward_records(spark):
    rows = [
        (1, "reg", None, None), (2, "reg", "Name", ""), (3, "reg", "Name", "[1]"), (4, "nerc_pages", None, "{}"),
        (5, "reg", "Name", '{"title": "  ", "headline": "Head", "type": null}'), (6, None, None, '{"title": "t"}'),
    ]
    events = spark.createDataFrame(rows, "raw_event_id long, source_id string, source_name string, payload string").withColumns({"event_date": F.lit(""), "url": F.when(F.col("raw_event_id") == 4, F.lit(None).cast("string")).otherwise("u")})
    got = {r["raw_event_id"]: r["headline"] for r in displays.regulatory_records(events).collect()}
    assert got == {
        1: 'reg document: "(untitled record)"', 2: 'Name document: "(untitled record)"', 3: 'Name document: "[1]"',
        4: "NERC page snapshot", 5: 'Name document: "Head"', 6: ' document: "t"',
    }
    assert displays.regulatory_records(events.limit(0)).collect() == []


def test_shortened(spark):
    cases = [("short", 9, "short"), ("one two three", 9, "one two…"), ("a bcdefghijkl", 9, "a bcdefg…"), ("abcdefghijkl", 5, "abcd…"), ("abc", 0, "abc")]
    rows = spark.createDataFrame(cases, "t string, n int, want string")
    assert rows.where(displays.shortened(F.col("t"), F.col("n")) != F.col("want")).collect() == []
