"""Tables in pages: docket rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import tables

SITE = "https://dockets.example"


def s11_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as docket tables: headers, broken dates, errata, links of both kinds, rows without docket or date."""
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("u"))
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("u", "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    day = F.expr("date_add(date '2017-01-01', cast(page_id % 3000 as int))")
    broken = F.concat(F.month(day), F.lit(" / "), F.dayofmonth(day), F.lit(" /"), F.floor(F.year(day) / 100), F.lit(" "), F.lpad((F.year(day) % 100).cast("string"), 2, "0"))
    number = F.col("page_id").cast("string")
    first = F.concat(
        F.lit("<tr>\n<td><p>NP-"), number, F.lit("</p></td><td>Notice of <b>Penalty</b><br/>for "), name, F.lit(' <A class="x>y" HREF="/n/'), number, F.lit('.pdf">Notice</A> <a>no</a> <a href="'),
        name, F.lit('">Errata &amp; more</a></td><td>'), broken, F.lit("<br>2/30/2019 and "), F.date_format(day, "M/d/yyyy"), F.lit("</td></tr>"),
    )
    second = F.concat(F.lit("<tr><td></td><td>Untitled "), number, F.lit("<td><!-- <td>gone</td> -->soon"))
    markup = F.concat(
        F.lit("<p>before</p><table><thead><tr><th>Docket Number</th><th>Title</th><th>Date</th></tr></thead><tbody><tr><td> docket No.</td><td>again</td></tr>"),
        first, F.lit("<tr><td>alone</td></tr><tr><td> </td><td></td><td>1/1/2020</td></tr>"), second, F.lit("</table>"),
    )
    none = F.lit(None).cast("string")
    content = F.array(F.struct(F.struct(none.alias("tableHtml")).alias("model")), F.struct(F.struct(markup.alias("tableHtml")).alias("model")))
    html = F.concat(F.lit("<html><script>window._model = "), F.to_json(F.struct(F.struct(content.alias("content")).alias("pageModel"))), F.lit("; other = {};</script></html>"))
    page = F.concat(F.lit(f"{SITE}/"), F.year(day))
    rows = tables.dockets(p.select(page.alias("page_url"), F.year(day).alias("filing_year"), html.alias("html")), SITE)
    return rows.select("filing_year", "docket", "title", "date_text", F.array_join("filing_dates", "|").alias("filing_dates"), F.array_join(F.col("links")["href"], "|").alias("hrefs"), "event_date", "url", "content_hash")


QUERIES = {f.__name__: f for f in (s11_dockets,)}

ORACLES = {
    "s11_dockets": rf"""WITH p AS (SELECT page_id, coalesce(url, '') AS u, date '2017-01-01' + CAST(page_id % 3000 AS INTEGER) AS d FROM pages),
r AS (SELECT d, 'NP-' || page_id AS docket, trim(regexp_replace('Notice of Penalty for ' || u || ' Notice no Errata & more', '\s+', ' ', 'g')) AS title,
        month(d) || ' / ' || day(d) || ' /' || year(d) // 100 || ' ' || lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0') || ' 2/30/2019 and ' || month(d) || '/' || day(d) || '/' || year(d) AS date_text,
        strftime(d, '%Y-%m-%d') || '|' || strftime(d, '%Y-%m-%d') AS filing_dates,
        '{SITE}/n/' || page_id || '.pdf' || CASE WHEN u = '' THEN '' ELSE '|' || CASE WHEN starts_with(u, '/') THEN '{SITE}' ELSE '' END || u END AS hrefs,
        strftime(d, '%Y-%m-%d') AS event_date, '{SITE}/n/' || page_id || '.pdf' AS url FROM p
      UNION ALL SELECT d, '', 'Untitled ' || page_id, 'soon', '', '', '', '{SITE}/' || year(d) FROM p)
SELECT CAST(year(d) AS INTEGER) AS filing_year, docket, title, date_text, filing_dates, hrefs, event_date, url,
       sha256(docket || chr(10) || title || chr(10) || date_text || CASE WHEN hrefs = '' THEN '' ELSE chr(10) || replace(hrefs, '|', chr(10)) END) AS content_hash FROM r""",
}
