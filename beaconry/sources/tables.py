"""Rows of HTML tables, and the docket rows that enforcement pages list in them."""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

LINK = StructType([StructField("text", StringType()), StructField("href", StringType())])
CELL = StructType([StructField("text", StringType()), StructField("header", BooleanType()), StructField("links", ArrayType(LINK))])
#: Comments, tags (marks in quoted values don't end them) and what stands between.
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)
HREF = re.compile(r"""(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
#: Tags that part words.
PARTING = frozenset("p br div li tr td th table ul ol tbody thead hr".split())
#: What a page's model stands after.
MODEL = "window._model = "


def table_rows(markup: str | None) -> list[list[dict]]:
    """The rows of all tables in a piece of HTML that have cells: each cell's text, links and whether it heads a column.

    Cells and rows end where the next one begins, closed or not. What a table inside a cell holds is that cell's text. Text outside
    of cells is left out. Entities are resolved, blanks squeezed.
    """
    rows: list[list[dict]] = []
    row = cell = link = None  # what is open
    inner = 0  # tables open inside the cell

    def close(whole_row: bool) -> None:
        nonlocal row, cell, link
        if cell is not None:
            link = None
            row.append({"text": squeezed(cell["text"]), "header": cell["header"], "links": [{"text": squeezed(x["text"]), "href": x["href"]} for x in cell["links"]]})
            cell = None
        if whole_row and row is not None:
            if row:
                rows.append(row)
            row = None

    for m in PIECE.finditer(markup or ""):
        if m["text"] is not None and cell is not None:
            said = _html.unescape(m["text"])
            cell["text"].append(said)
            if link is not None:
                link["text"].append(said)
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if cell is not None and tag in PARTING:
            cell["text"].append(" ")
            if link is not None:
                link["text"].append(" ")
        if tag == "table" and cell is not None and (inner or not m["end"]):
            inner += -1 if m["end"] else 1
        elif inner and tag != "a":
            continue
        elif tag in ("tr", "table"):
            close(whole_row=True)
            row = [] if tag == "tr" and not m["end"] else None
        elif tag in ("td", "th"):
            close(whole_row=False)
            if not m["end"] and row is not None:
                cell = {"text": [], "links": [], "header": tag == "th"}
        if tag == "a" and cell is not None:
            link = None
            if not m["end"]:
                href = HREF.search(m["rest"])
                link = {"text": [], "href": _html.unescape(next((x for x in href.groups() if x is not None), "")) if href else ""}
                cell["links"].append(link)
    inner = 0
    close(whole_row=True)
    return rows


def squeezed(chunks: list[str]) -> str:
    return " ".join("".join(chunks).split())


@F.pandas_udf(ArrayType(ArrayType(CELL)))
def tables_of(markup: pd.Series) -> pd.Series:
    """The rows of the tables of each piece of HTML."""
    return markup.map(table_rows)


def model_tables(html: Column) -> Column:
    """The pieces of table HTML in a page's embedded model, in its order. A page without a model has null."""
    model = F.when(F.instr(html, MODEL) > 0, F.substring_index(html, MODEL, -1))
    content = F.from_json(model, "pageModel struct<content array<struct<model struct<tableHtml string>>>>")["pageModel"]["content"]
    pieces = F.filter(F.transform(content, lambda c: c["model"]["tableHtml"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(model.isNotNull(), F.coalesce(pieces, F.array().cast("array<string>")))


def us_dates(text: Column) -> Column:
    """The ISO dates of all M/D/YYYY in a text, whatever blanks stand inside them; impossible ones are left out."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    found = F.regexp_extract_all(bare, F.lit(r"(\d{1,2}/\d{1,2}/\d{4})"), 1)
    return F.array_compact(F.transform(found, lambda d: F.date_format(F.try_to_date(d, "M/d/yyyy"), "yyyy-MM-dd")))


def dockets(pages: DataFrame, site: str) -> DataFrame:
    """One row per docket row of pages (page_url, filing_year, html): page_url, filing_year, place, docket, title, date_text, filing_dates, links,
    event_date, url and content_hash.

    Header rows, rows of one cell, and rows with neither docket nor title go. The hash is over docket, title, date text and the
    links' addresses, so an amended row is a new event and an unchanged one is not, whatever page it stands on. A page
    without a model, or whose model has no tables, has no rows.
    """
    pieces = pages.select("page_url", "filing_year", F.posexplode(model_tables(F.col("html"))).alias("_table", "_markup"))
    rows = pieces.select("page_url", "filing_year", "_table", F.posexplode(tables_of("_markup")).alias("_row", "_cells"))
    said = lambda i: F.coalesce(F.get("_cells", F.lit(i))["text"], F.lit(""))
    listed = rows.where((F.size("_cells") >= 2) & ~F.exists("_cells", lambda c: c["header"]))
    listed = listed.select(
        "page_url", "filing_year", F.struct(F.col("_table").alias("table"), F.col("_row").alias("row")).alias("place"),
        said(0).alias("docket"), said(1).alias("title"), said(2).alias("date_text"), F.get("_cells", F.lit(1))["links"].alias("_links"),
    )
    listed = listed.where(((F.col("docket") != "") | (F.col("title") != "")) & ~F.lower("docket").startswith("docket"))
    whole = lambda href: F.when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(href)
    links = F.transform(F.filter("_links", lambda x: x["href"] != ""), lambda x: F.struct(x["text"].alias("text"), whole(x["href"]).alias("href")))
    out = listed.withColumns({"links": links, "filing_dates": us_dates(F.col("date_text"))}).drop("_links")
    hrefs = F.col("links")["href"]
    return out.withColumns(
        {
            "event_date": F.coalesce(F.get("filing_dates", F.lit(0)), F.lit("")),
            "url": F.coalesce(F.get(hrefs, F.lit(0)), F.col("page_url")),
            "content_hash": F.sha2(F.array_join(F.concat(F.array("docket", "title", "date_text"), hrefs), "\n"), 256),
        }
    )
