"""HTML tables and docket rows on known and awkward markup."""

import json

import pytest

from beaconry.sources import tables

SITE = "https://site.example"


def texts(markup):
    return [[c["text"] for c in row] for row in tables.table_rows(markup)]


@pytest.mark.parametrize(
    ("markup", "rows"),
    [
        (None, []),
        ("", []),
        ("no table <td>x</td>", []),
        ("<tr><td>a<td>b<tr><td>c", [["a", "b"], ["c"]]),
        ("<table><tr></tr><tr><td></td></tr></table>", [[""]]),
        ("<tr><td>a &amp; b&nbsp;&lt;c&gt; < d</td></tr>", [["a & b <c> < d"]]),
        ("<TR><TD title='a>b'>one<BR/>two<p>three</p></TD></TR>", [["one two three"]]),
        ("<tr><td>a<table><tr><td>in</td><td>ner</td></tr></table>b</td><td>c</td></tr>", [["a in ner b", "c"]]),
        ("<tr><td>a<!-- <td>x</td> -->b</td><td>open <!-- to the end</td></tr>", [["ab", "open"]]),
        ("<tr><td>in</td> out </tr> out <td>lost</td>", [["in"]]),
        ("<tr><td>b<b>ol</b>d</td></tr>", [["bold"]]),
    ],
)
def test_cells(markup, rows):
    assert texts(markup) == rows


def test_links_and_headers():
    row = tables.table_rows("""<tr><th>H</th><td><a href="/a?x=1&amp;y=2">A <i>one</i></a>, <a class=c href=/b>B</a><a name="n">N</a><a data-href="no" href='c d'>C</td><td><a href="/d">D</a></td></tr>""")[0]
    assert [c["header"] for c in row] == [True, False, False]
    assert row[1]["links"] == [{"text": "A one", "href": "/a?x=1&y=2"}, {"text": "B", "href": "/b"}, {"text": "N", "href": ""}, {"text": "C", "href": "c d"}]
    assert row[2]["links"] == [{"text": "D", "href": "/d"}]


def test_a_very_long_table_takes_one_pass():
    assert len(texts("<tr><td>x</td><td>y</td></tr>" * 50_000 + "<" * 50_000)) == 50_000


def page(*tables_, extra=""):
    content = [None, {"model": None}, {"other": 1}, *({"model": {"tableHtml": t}} for t in tables_)]
    return f"<html>{extra}<script>window._model = {json.dumps({'pageModel': {'content': content}})}; more {{ }}</script>"


def test_dockets(spark):
    head = "<tr><th>Docket Number</th><th>Title</th><th>Date</th></tr>"
    one = '<tr><td>NP26-1-000</td><td>Penalty <a href="https://e/1">Notice</a><a href="/two.pdf">Errata</a></td><td>01/29/2026<br> 2 / 18 /20 26, 13/1/2026</td></tr>'
    rows = [
        ("p1", 2026, page(head + one, "<tr><td></td><td>only a title</td></tr><tr><td>Docket No</td><td>x</td><td>1/1/2026</td></tr>")),
        ("p2", 2025, page(one)),
        ("p3", 2025, "<html>no model</html>"),
        ("p4", 2025, "window._model = not json"),
        ("p5", 2025, None),
        ("p6", None, page()),
    ]
    df = spark.createDataFrame(rows, "page_url string, filing_year int, html string")
    got = sorted((r.asDict(recursive=True) for r in tables.dockets(df, SITE).collect()), key=lambda r: (r["page_url"], r["docket"]))
    assert [(r["page_url"], r["docket"], r["event_date"], r["filing_dates"], r["url"]) for r in got] == [
        ("p1", "", "", [], "p1"),
        ("p1", "NP26-1-000", "2026-01-29", ["2026-01-29", "2026-02-18"], "https://e/1"),
        ("p2", "NP26-1-000", "2026-01-29", ["2026-01-29", "2026-02-18"], "https://e/1"),
    ]
    assert [x["href"] for x in got[1]["links"]] == ["https://e/1", f"{SITE}/two.pdf"]
    assert got[1]["content_hash"] == got[2]["content_hash"] != got[0]["content_hash"]
    changed = tables.dockets(df.limit(1).selectExpr("page_url", "filing_year", "replace(html, '20 26', '20 27') AS html"), SITE).where("docket <> ''").first()
    assert changed["content_hash"] != got[1]["content_hash"]
