"""Rules on single rows, null and blank ones among them."""

from beaconry.operators import obligations, page_changes, rules
from beaconry.sources import normalize


def told(df):
    return sorted((r["raw_event_id"], r["trigger_id"], r["scope"], r["name_hint"], r["confidence"], tuple(r["locators"])) for r in df.collect())


def test_appointments(spark):
    press = [
        ("a", "Norwind Energy appoints Kim Lee as Chief Information Security Officer", None),
        ("b", "Kim Lee joins Norwind Energy as CIO", ""),
        ("c", "Norwind Energy names Kim Lee CSO", "A cyber security veteran."),
        ("d", "Norwind Energy names Kim Lee CSO", "A strategist."),
        ("e", "Norwind Energy names Kim Lee, once CISO, as chief of staff", None),
        ("f", "1234 names a CISO", None),
        ("g", "norwind hires a ciso", None),
        ("h", None, None),
        ("i", "", ""),
        ("j", "Norwind Energy names Kim Lee CSO", "x " * 400 + "cyber security"),
    ]
    got = told(rules.appointments(spark.createDataFrame([(*r, "2024-01-02") for r in press], "raw_event_id string, title string, description string, event_date string")))
    assert [(r[0], r[3], r[4], r[5]) for r in got] == [("a", "Norwind Energy", 0.9, ("title",)), ("b", "Norwind Energy", 0.75, ("title",)), ("c", "Norwind Energy", 0.9, ("title", "description"))]


def test_statements(spark):
    titles = ["Norwind confirms cyber-attack", "Norwind reports breach of contract", "Norwind provides an update on data breach", "Data breach: Norwind says nothing", None]
    got = told(rules.company_statements(spark.createDataFrame([(str(i), t, None) for i, t in enumerate(titles)], "raw_event_id string, title string, event_date string")))
    assert [(r[0], r[3]) for r in got] == [("0", "Norwind"), ("2", "Norwind")]


def test_documents_need_a_clock_and_a_known_agency(spark):
    ferc = '"agencies":[{"slug":"federal-energy-regulatory-commission","name":"F"}]'
    rows = [
        ("a", '{"title":"Reliability Standard CIP-003","type":"Rule","effective_on":"2024-05-01",%s}' % ferc),
        ("b", '{"title":"Reliability Standard CIP-003","type":"Rule",%s}' % ferc),
        ("c", '{"title":"Norwind Corp.; Notice of Penalty","type":"Notice","abstract":"CIP penalty. Owners must comply.",%s}' % ferc),
        ("d", '{"title":"Reliability Standard CIP-003","type":"Rule","effective_on":"2024-05-01"}'),
        ("e", "not json"),
        ("f", None),
        ("g", '{"title":"Norwind Holdings; Notice of Penalty","type":"Notice","abstract":"CIP penalty.","comments_close_on":"2024-06-01",%s}' % ferc),
    ]
    got = told(rules.regulatory_documents(spark.createDataFrame([(*r, "2024-01-02") for r in rows], "raw_event_id string, payload string, event_date string")))
    assert got == [
        ("a", "nerc_cip_revision", "sector", None, 0.8, ("title", "effective_on")),
        ("c", "nerc_enforcement", "account", "Norwind Corp.", 0.75, ("title", "abstract")),
        ("c", "nerc_enforcement", "sector", None, 0.8, ("title", "abstract")),
        ("g", "nerc_enforcement", "sector", None, 0.8, ("title", "abstract", "comments_close_on")),
    ]


def test_empty_tables(spark):
    assert rules.appointments(spark.createDataFrame([], "raw_event_id string, title string, description string, event_date string")).count() == 0
    assert rules.regulatory_documents(spark.createDataFrame([], "raw_event_id string, payload string, event_date string")).count() == 0


def test_feeds_read_what_cannot_be_read_as_blank(spark):
    pages = spark.createDataFrame([("{}",), (None,), ("[",), ('{"results":[{"document_number":"d1"}]}',)], "payload string")
    assert [tuple(r)[:3] for r in normalize.documents(pages).collect()] == [("d1", "", "")]
    items = spark.createDataFrame([("https://x.gov/a/b-1/?q=/z", None, "Thu, 13 Aug 26 12:00:00 +0000", "t"), (None, " g ", "Mon, 5 Jan 98 01:00:00 -0400", "t"), (None, None, None, None)], "link string, guid string, pub_date string, title string")
    assert sorted(tuple(r)[:2] for r in normalize.advisories(items, "1990-01-01").collect()) == [("", ""), ("b-1", "2026-08-13"), ("g", "1998-01-05")]


def test_leaks_and_press_follow_the_resolution(spark):
    res = spark.createDataFrame([("a", "matched", "E1", 0.4), ("b", "none", None, 0.0), ("c", "review", None, 0.9)], "raw_event_id string, status string, entity_id string, confidence double")
    rows = [(k, crew, "Norwind", industry, "2024-01-02 10:00") for k, crew, industry in (("a", None, "Retail"), ("b", "x", "Energy & Utilities"), ("c", "x", "energy"), ("d", "x", "energy"))]
    leaks = rules.leak_listings(spark.createDataFrame(rows, "raw_event_id string, crew string, victim string, industry string, event_date string"), res)
    assert told(leaks) == [("a", "own_incident", "account", None, 0.4, ("victim",)), ("b", "peer_incident", "sector", None, 0.45, ("victim",))]
    assert {r["raw_event_id"]: r["headline"] for r in leaks.collect()}["a"] == "Listed on a ransomware leak site - unverified early warning"
    titles = [(k, "Norwind hit by cyber attack", "the_record") for k in "abcd"] + [("e", "Crew claims responsibility", "bleepingcomputer"), ("f", "Crew claims responsibility", "the_record"), ("g", "99 reports data breach, data for sale", "bleepingcomputer"), ("h", None, "bleepingcomputer")]
    press = rules.press_disclosures(spark.createDataFrame([(*t, None) for t in titles], "raw_event_id string, title string, source string, event_date string"))
    got = rules.press_incidents(press, res)
    assert told(got) == [("a", "own_incident", "account", None, 0.4, ("title",)), ("b", "peer_incident", "sector", None, 0.6, ("source",)), ("e", "peer_incident", "sector", None, 0.45, ("source",))]
    assert {r["raw_event_id"]: r["tier"] for r in got.collect()} == {"a": "corroborated", "b": "corroborated", "e": "unconfirmed_early_warning"}


def test_entities_are_all_resolved(spark):
    from beaconry.functions import text

    rows = spark.createDataFrame([("<b>caf&eacute;</b> &#8217;s&nbsp;&nbsp;&amp;lt; &#x41;",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(text.plain_text(rows.t)).collect()] == ["café ’s &lt; A", None, ""]


def test_page_changes(spark):
    old = " ".join(f"w{i}" for i in range(40))
    new = " ".join([*(f"w{i}" for i in range(20)), "CIP-003", "and", "CIP-001", *(f"w{i}" for i in range(20, 40)), "CIP-003"])
    rows = [("a", None, new, old), ("b", None, new, None), ("c", None, new, new), ("d", None, None, old), ("e", None, old, new), ("f", None, "see CIP-1234 CIP-0123", "see")]
    got = page_changes.standard_changes(spark.createDataFrame(rows, "url string, event_date string, text string, prev string")).collect()
    around = "w12 w13 w14 w15 w16 w17 w18 w19 CIP-003 and CIP-001 w20 w21 w22 w23 w24 w25 w26 w27"
    assert sorted((r["url"], r["standard"], r["snippet"]) for r in got) == [("a", "CIP-001", around), ("a", "CIP-003", around)]


def test_obligations_need_a_clock_and_stay_once_made(spark):
    agency = '"agencies":[{"slug":"transportation-security-administration","name":"TSA"}]'
    docs = spark.createDataFrame([("a", '{"title":"On CIP-002, CIP-001 and CIP-002","effective_on":"2024-05-01",%s}' % agency), ("b", '{"title":"x",%s}' % agency), ("c", None)], "raw_event_id string, payload string")
    signals = [("s1", "a", "active"), ("s2", "a", "retracted"), ("s3", "b", "active"), ("s4", "c", "active"), ("s5", "a", "active"), ("s6", "none", "active")]
    frame = spark.createDataFrame([(s, r, "tsa_security_directive", st, None) for s, r, st in signals], "signal_id string, raw_event_id string, trigger_id string, status string, source_url string")
    rows = obligations.considered(frame, docs, spark.createDataFrame([("obligation:s5",)], "obligation_id string"))
    assert {r["signal_id"]: r["outcome"] for r in rows.collect()} == {"s1": "new", "s3": "skipped_no_clock", "s4": "skipped_no_clock", "s5": "existing", "s6": "skipped_no_clock"}
    products = spark.createDataFrame([("CIP-001", 0, "p1"), ("CIP-002", 0, "p2"), ("CIP-002", 1, "p1")], "standard string, place int, product string")
    assert [(r["signal_id"], r["mapped_products"], r["applicability_rule"]) for r in obligations.derived(rows, products).collect()] == [("s1", "p2;p1", "subsector_in:lng;midstream")]
