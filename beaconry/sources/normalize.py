"""Landed records of each feed as events of one shape.

Every normaliser takes rows with a JSON text `payload` (or the columns named) and gives native_id, event_date
(ISO text, '' if undated) and url beside what the feed adds. Parsing never fails: what can't be read is null or ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import in_window, short_us_date
from ..functions.text import plain_text

FILING_FORMS = ["8-K", "8-K/A", "10-K", "10-K/A"]
SUBMISSIONS = "accessionNumber array<string>, filingDate array<string>, form array<string>, items array<string>, primaryDocument array<string>"


def iso(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def filings(submissions: DataFrame, cutoff: str) -> DataFrame:
    """Parallel arrays, cut to the shortest, as one row per filing of a wanted form within the window."""
    names = [x.split()[0] for x in SUBMISSIONS.split(", ")]
    s = F.from_json("payload", SUBMISSIONS)
    rows = submissions.withColumn("s", s)
    n = F.least(*(F.coalesce(F.size(F.col(f"s.{c}")), F.lit(0)) for c in names))
    arrays = [F.slice(F.col(f"s.{c}"), F.lit(1), F.greatest(n, F.lit(0))).alias(c) for c in names]
    flat = rows.select("entity_id", F.inline(F.arrays_zip(*arrays)))
    fine = flat.where(F.col("form").isin(FILING_FORMS) & in_window(F.col("filingDate"), cutoff, keep_undated=False))
    items = F.filter(F.transform(F.split("items", ","), lambda x: F.trim(x)), lambda x: x != "")
    return fine.select("entity_id", F.col("accessionNumber").alias("native_id"), F.col("filingDate").alias("event_date"), "form", items.alias("items"), "primaryDocument")


def catalog(records: DataFrame, cutoff: str) -> DataFrame:
    """Catalog entries; those without a date stay."""
    v = F.from_json("payload", "vulnerabilities array<struct<cveID string, dateAdded string>>")
    rows = records.select(F.explode(v["vulnerabilities"]).alias("v"))
    return rows.select(F.col("v.cveID").alias("native_id"), F.coalesce("v.dateAdded", F.lit("")).alias("event_date")).where(in_window(F.col("event_date"), cutoff, keep_undated=True))


def fulltext_hits(pages: DataFrame) -> DataFrame:
    """Search answers (entity_id, matched_name, JSON `payload`) as a row per entity and hit; a url only for numeric company codes."""
    hit = "hits array<struct<_id string, _source struct<ciks array<string>, adsh string, file_date string>>>"
    h = pages.select("entity_id", "matched_name", F.explode(F.from_json("payload", f"hits struct<{hit}>")["hits"]["hits"]).alias("h"))
    code = F.regexp_replace(F.trim(F.coalesce(F.get("h._source.ciks", F.lit(0)), F.lit(""))), "^0+", "")
    hit_id = F.coalesce("h._id", F.lit(""))
    at = F.instr(hit_id, ":")
    number = F.coalesce(F.nullif(F.substring_index(hit_id, ":", 1), F.lit("")), "h._source.adsh", F.lit(""))
    file = F.when(at > 0, F.substr(hit_id, at + 1)).otherwise("")
    url = F.when(code.rlike(r"^\d+$") & (number != ""), F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), code, F.lit("/"), F.replace(number, F.lit("-"), F.lit("")), F.lit("/"), file))
    return h.select("entity_id", "matched_name", F.concat_ws(":", "entity_id", hit_id).alias("native_id"), F.coalesce("h._source.file_date", F.lit("")).alias("event_date"), F.coalesce(url, F.lit("")).alias("url"))


def documents(pages: DataFrame) -> DataFrame:
    """Pages of a regulator's documents as a row per document, its JSON whole in `payload`."""
    each = pages.select(F.explode(F.from_json("payload", "results array<string>")["results"]).alias("payload"))
    field = lambda n: F.coalesce(F.get_json_object("payload", f"$.{n}"), F.lit(""))
    return each.select(field("document_number").alias("native_id"), field("publication_date").alias("event_date"), field("html_url").alias("url"), "payload")


def advisories(items: DataFrame, cutoff: str) -> DataFrame:
    """Advisories: the last part of the link's path names one, else its guid; unreadable dates stay, undated."""
    path = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("link", F.lit(""))), r"^[A-Za-z][\w+.\-]*://[^/?#]*", ""), r"(?s)/*(?:[?#].*)?$", "")
    slug = F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), F.trim("guid"), F.lit(""))
    return rss_items(items.withColumn("guid", slug), cutoff)


def cves(pages: DataFrame, detail: str = "https://nvd.nist.gov/vuln/detail/") -> DataFrame:
    """Pages of vulnerabilities, dated by the day they were published, with the address of their detail page as url."""
    v = pages.select(F.explode(F.from_json("payload", "vulnerabilities array<struct<cve struct<id string, published string>>>")["vulnerabilities"]).alias("v"))
    return v.select(F.coalesce("v.cve.id", F.lit("")).alias("native_id"), F.substring(F.trim(F.coalesce("v.cve.published", F.lit(""))), 1, 10).alias("event_date"), F.concat(F.lit(detail), F.coalesce("v.cve.id", F.lit(""))).alias("url"))


def calendar(months: DataFrame, site: str, today: str) -> DataFrame:
    """Calendar months (year, month, JSON `payload`): dated by the selected zone, else any, else the day of the grid; past days go."""
    items = "allItems array<struct<url string, day string, dateInfoByTimeZone array<struct<isSelected boolean, eventStartDate string>>>>"
    rows = months.select("year", "month", F.explode(F.from_json("payload", items)["allItems"]).alias("i"))
    days = lambda infos: F.get(F.filter(F.transform(infos, lambda x: F.regexp_extract(x["eventStartDate"], r"^(\d{4}-\d{2}-\d{2})", 1)), lambda d: d != ""), F.lit(0))
    infos, grid = F.col("i.dateInfoByTimeZone"), F.trim("i.day")
    of_grid = F.when(grid.rlike(r"^\d+$"), F.format_string("%04d-%02d-%02d", "year", "month", grid.cast("int")))
    day = F.coalesce(days(F.filter(infos, lambda x: x["isSelected"])), days(infos), of_grid, F.lit(""))
    path = F.trim(F.coalesce("i.url", F.lit("")))
    out = rows.select(path.alias("native_id"), day.alias("event_date"), F.when(path.startswith("/"), F.concat(F.lit(site), path)).otherwise(path).alias("url"))
    return out.where((F.col("event_date") == "") | (F.col("event_date") >= today))


def awards(pages: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Pages of awards with all four required fields; given `terms` (term), only those whose recipient is one of them, letter case aside."""
    each = pages.select(F.explode(F.from_json("payload", "results array<string>")["results"]).alias("payload"))
    names = {"Award ID": "native_id", "Recipient Name": "recipient", "Awarding Agency": "agency", "Start Date": "event_date"}
    rows = each.select(*(F.trim(F.get_json_object("payload", f"$['{n}']")).alias(a) for n, a in names.items()), "payload")
    rows = rows.where(" and ".join(f"coalesce({a}, '') <> ''" for a in names.values()))
    return rows if terms is None else rows.join(terms.select(F.lower("term").alias("_t")), F.lower("recipient") == F.col("_t"), "left_semi")


def capacity(records: DataFrame) -> DataFrame:
    """Plant capacity: a key of three parts, blank if any is; periods of a year, month or day as dates."""
    p = F.from_json("payload", "plantid string, generatorid string, period string")
    rows = records.select(p.alias("p")).select("p.*")
    whole = F.forall(F.array("plantid", "generatorid", "period"), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    period = F.coalesce("period", F.lit(""))
    padded = F.when(period.rlike(r"^\d{4}$"), F.concat(period, F.lit("-01-01"))).when(period.rlike(r"^\d{4}-\d{2}$"), F.concat(period, F.lit("-01"))).when(period.rlike(r"^\d{4}-\d{2}-\d{2}$"), period)
    return rows.select(F.when(whole, F.concat_ws(":", "plantid", "generatorid", "period")).otherwise("").alias("native_id"), iso(F.try_to_date(padded, "yyyy-MM-dd")).alias("event_date"))


def news(records: DataFrame) -> DataFrame:
    """Articles with compact dates of two forms; of those with one url the first by order, blank urls all."""
    a = F.from_json("payload", "url string, title string, seendate string")
    rows = records.select("order", a.alias("a")).select("order", F.coalesce("a.url", F.lit("")).alias("url"), F.col("a.title").alias("title"), F.col("a.seendate").alias("seen"))
    day = F.coalesce(F.try_to_timestamp("seen", F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp("seen", F.lit("yyyyMMddHHmmss")))
    key = F.when(F.col("url") == "", F.concat(F.lit("#"), F.col("order").cast("string"))).otherwise(F.col("url"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("order")) == 1
    return rows.withColumn("first", first).where("first").select(F.col("url").alias("native_id"), iso(F.to_date(day)).alias("event_date"), "url", "title")


def page_snapshots(pages: DataFrame) -> DataFrame:
    """Visible text of pages, and a hash over url and text that stays while the page does."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    rows = pages.select(F.col("url"), plain_text(F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")).alias("text"))
    return rows.select("url", "text", F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256).alias("content_hash"))


def enforcement(rows: DataFrame, cutoff: str) -> DataFrame:
    """Enforcement rows: required cells filled, US dates with a century pivot, undated rows dropped."""
    fine = F.forall(F.array("case_id", "operator", "case_type"), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    dated = rows.where(fine).withColumn("event_date", iso(short_us_date(F.col("opened"))))
    return dated.where((F.col("event_date") != "") & in_window(F.col("event_date"), cutoff, keep_undated=False)).select(F.col("case_id").alias("native_id"), "event_date", "operator", "case_type")


def settled_cases(records: DataFrame, cutoff: str) -> DataFrame:
    """Cases by settlement date, else filing date; undated ones go."""
    c = F.from_json("payload", "CaseNumber string, CaseName string, SettlementDate string, DateFiled string")
    rows = records.select(c.alias("c")).select("c.*")
    day = iso(F.coalesce(short_us_date(F.col("SettlementDate")), short_us_date(F.col("DateFiled"))))
    out = rows.select(F.col("CaseNumber").alias("native_id"), day.alias("event_date"), F.col("CaseName").alias("name"))
    return out.where((F.col("event_date") != "") & in_window(F.col("event_date"), cutoff, keep_undated=False))


def listings(records: DataFrame) -> DataFrame:
    """Victim listings: discovered else attack date; without an id a hash of the name-sorted JSON."""
    fields = ["activity", "attackdate", "discovered", "group", "id", "victim"]
    v = F.from_json("payload", ", ".join(f"`{f}` string" for f in fields))
    rows = records.select(v.alias("v")).select("v.*")
    canonical = F.to_json(F.struct(*sorted(fields)))
    own = F.nullif(F.trim("id"), F.lit(""))
    return rows.select(
        F.coalesce(own, F.concat(F.lit("h:"), F.substring(F.sha2(canonical, 256), 1, 24))).alias("native_id"),
        F.substring(F.coalesce(F.nullif("discovered", F.lit("")), "attackdate", F.lit("")), 1, 10).alias("event_date"),
        F.col("group").alias("crew"), "victim", F.col("activity").alias("industry"),
    )


def rss_items(items: DataFrame, cutoff: str) -> DataFrame:
    """RSS items (title, link, guid, pub_date): the guid else the link names it; unreadable dates stay, undated.

    Years of two digits up to 68 are of this century.
    """
    text = F.regexp_replace("pub_date", r"^\s*\w+,\s*", "")
    text = F.regexp_replace(text, r"^(\d{1,2}\s+\w{3}\s+)(69|[7-9]\d)\s", "$119$2 ")
    text = F.regexp_replace(text, r"^(\d{1,2}\s+\w{3}\s+)(\d{2})\s", "$120$2 ")
    at = F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z"))
    out = items.select(F.coalesce(F.nullif(F.trim("guid"), F.lit("")), F.trim("link"), F.lit("")).alias("native_id"), iso(at).alias("event_date"), "title", F.col("link").alias("url"))
    return out.where(in_window(F.col("event_date"), cutoff, keep_undated=True))
