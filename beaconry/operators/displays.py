"""How records that gave no signal are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import blank

# Labels of document types and page snapshots, the fixed agency of these, and bounds in characters.
LABELS = {"Rule": "final rule", "Proposed Rule": "proposed rule", "Notice": "notice"}
SNAPSHOT_SOURCE, SNAPSHOT_AGENCY, SNAPSHOT = "nerc_pages", "NERC", "page snapshot"
MOST_HEADLINE, MOST_SNIPPET = 140, 200
UNTITLED = "(untitled record)"

PAYLOAD = (
    "title string, headline string, name string, summary string, type string, page_url string, effective_on string, comments_close_on string, "
    "agencies array<struct<name string, raw_name string>>, agency_names array<string>, docket_ids array<string>"
)


def _given(value: Column) -> Column:
    return F.nullif(blank(value), F.lit(""))


def shortened(text: Column, most: Column) -> Column:
    """At most so many characters, the last an ellipsis if it is cut: at a blank, if one stands in the second half."""
    cut = F.rtrim(F.substring(text, F.lit(1), most - 1))
    before = F.length(cut) - F.instr(F.reverse(cut), " ")  # characters before the last blank; all, if there is none
    at_blank = F.when((before < F.length(cut)) & (before >= F.floor(most / 2)), F.rtrim(F.substring(cut, F.lit(1), before))).otherwise(cut)
    return F.when((most < 1) | (F.length(text) <= most), text).otherwise(F.concat(at_blank, F.lit("…")))


def page_label(url: Column) -> Column:
    """The last segment of a url's path that isn't blank, or the url."""
    parts = F.filter(F.transform(F.split(F.regexp_extract(url, r"^([^?#]*)", 1), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), url)


def regulatory_records(events: DataFrame) -> DataFrame:
    """Landed regulatory records as shown: agency, label, title, headline, whether a date binds, dockets and dates.

    `events` has raw_event_id, source_id, source_name, event_date, url and a JSON payload. Nothing is inferred: a payload that
    isn't an object has no fields, and its own text, shortened, is the title; blank titles fall back the same way.
    """
    p = lambda c: F.col(f"_p.{c}")
    is_page = F.coalesce(F.col("source_id") == SNAPSHOT_SOURCE, F.lit(False))
    named = F.transform(p("agencies"), lambda a: _given(F.coalesce(F.nullif(a["name"], F.lit("")), a["raw_name"])))
    listed = F.filter(F.concat(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(F.transform(p("agency_names"), _given), F.array().cast("array<string>"))), lambda x: x.isNotNull())
    agency = F.when(is_page, SNAPSHOT_AGENCY).otherwise(F.coalesce(F.get(listed, F.lit(0)), F.nullif("source_name", F.lit("")), "source_id", F.lit("")))
    kind = F.coalesce(F.nullif(p("type"), F.lit("")), F.lit("document"))
    for name, shown in LABELS.items():
        kind = F.when(p("type") == name, shown).otherwise(kind)
    snippet = F.substring(F.coalesce(_given(p("headline")), _given(p("name")), _given(p("summary")), F.nullif("payload", F.lit(""))), 1, MOST_SNIPPET)
    page = page_label(blank(F.coalesce(F.nullif(p("page_url"), F.lit("")), "url")))
    rows = events.withColumn("_p", F.from_json("payload", PAYLOAD)).withColumns({"agency": agency, "doc_type_label": F.when(is_page, SNAPSHOT).otherwise(kind)})
    rows = rows.withColumn("title", F.when(is_page, page).otherwise(F.coalesce(_given(p("title")), snippet, F.lit(UNTITLED))))
    head = F.concat("agency", F.lit(" "), "doc_type_label")
    quoted = F.concat(head, F.lit(': "'), shortened(F.col("title"), MOST_HEADLINE - F.length(head) - 4), F.lit('"'))
    shown = F.when(~is_page, quoted).when(F.col("title") != "", F.concat(head, F.lit(": "), "title")).otherwise(head)
    clock = lambda c: F.nullif(p(c), F.lit(""))
    return rows.select(
        "raw_event_id", "source_id", "source_name", "agency", "doc_type_label", "title", shown.alias("headline"),
        F.coalesce(clock("effective_on"), clock("comments_close_on")).isNotNull().alias("has_anchor"),
        "event_date", "url", F.coalesce(p("docket_ids"), F.array().cast("array<string>")).alias("docket_ids"),
        clock("comments_close_on").alias("comments_close_on"), clock("effective_on").alias("effective_on"),
    )
