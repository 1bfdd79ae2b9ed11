"""Text predicates and projections: column in, column out, inside whole-stage code but for HTML's entities (an Arrow UDF)."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Trailing corporate words dropped from names.
CORPORATE_SUFFIXES = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "lp", "plc", "ltd", "limited",
    "holdings", "holding", "group",
]
# Words one of which a company named in a notice's title must have.
LEGAL_FORMS = ["inc", "incorporated", "llc", "lc", "llp", "lp", "ltd", "limited", "corp", "corporation", "company", "co", "plc"]
# Tags that count as the watchlist's own industry.
PEER_INDUSTRIES = ["energy", "energy and utilities", "utilities", "oil and gas"]
TRACKER_HOSTS = ["ransomware.live"]
TRACKER_INDEX = "https://www.ransomware.live/"
PUBLIC_SCOPES = ["account", "parent"]
TYPE_LABELS = {"Rule": "final rule", "Proposed Rule": "proposed rule", "Notice": "notice"}
ELLIPSIS = "…"


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized_name(name: Column) -> Column:
    """Lower case, & as and, marks as blanks, trailing corporate words dropped; null gives ''."""
    spaced = F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), r"(?U)[^\w\s]", " ")
    words = "|".join(CORPORATE_SUFFIXES)
    return F.trim(F.regexp_replace(squeezed(spaced), rf"(?:(?:^|\s)(?:{words}))+$", ""))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Numeric and all named entities of HTML resolved; null stays."""
    return text.map(_html.unescape, na_action="ignore")


def plain_text(html: Column) -> Column:
    """Tags out, entities resolved, white space squeezed; null stays."""
    return squeezed(unescaped(F.regexp_replace(html, r"<[^>]+>", " ")))


def plausible_company(text: Column) -> Column:
    """A hint of 2 to 80 characters and ten words at most that has a Latin letter, without edge marks; else ''."""
    hint = F.regexp_replace(text, r"(?U)^[\s,;:.\-–—]+|[\s,;:.\-–—]+$", "")
    fine = F.length(hint).between(2, 80) & (F.size(F.split(squeezed(hint), " ")) <= 10) & hint.rlike("[A-Za-z]")
    return F.when(fine, hint).otherwise("")


def case_name(name: Column) -> Column:
    """A case's name without parentheses, however deeply nested, and without a closing ET AL."""
    text = F.coalesce(name, F.lit(""))
    opened = F.length(F.regexp_replace(text, r"[^(]", ""))  # each pass closes one at least
    out = F.aggregate(F.sequence(F.lit(0), opened), text, lambda x, _: F.regexp_replace(x, r"\([^()]*\)", ""))
    return F.btrim(squeezed(F.regexp_replace(out, r"(?i),?\s*ET\s+AL\.?\s*$", "")), F.lit(" ,"))


def cut_to(text: Column, most: int) -> Column:
    """At most `most` characters; what is longer ends in an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit(ELLIPSIS))).otherwise(text)


def headline(agency: Column, kind: Column, title: Column, most: int = 140) -> Column:
    """`agency kind: title`, the kind in plain words."""
    label = F.lit(None).cast("string")
    for key, words in TYPE_LABELS.items():
        label = F.when(kind == key, words).otherwise(label)
    return cut_to(F.concat(agency, F.lit(" "), F.coalesce(label, F.nullif(kind, F.lit("")), F.lit("document")), F.lit(": "), title), most)


def title_cut(title: Column, budget: int) -> Column:
    """A title within its budget, broken at a word if one ends in its second half."""
    if budget < 1:
        return title
    cut = F.rtrim(F.substring(title, 1, budget - 1))
    last = F.length(cut) - F.length(F.substring_index(cut, " ", -1))  # characters up to and with the last blank
    at_word = (last > 0) & (last - 1 >= budget // 2)
    return F.when(F.length(title) <= budget, title).otherwise(F.concat(F.when(at_word, F.rtrim(F.substring(cut, F.lit(1), last))).otherwise(cut), F.lit(ELLIPSIS)))


def payload_snippet(payload: Column, most: int = 200) -> Column:
    """struct(snippet, truncated, omitted): the first telling field of a JSON object, else the payload itself."""
    fields = [F.nullif(F.trim(F.get_json_object(payload, f"$.{k}")), F.lit("")) for k in ("title", "headline", "name", "summary")]
    found = F.coalesce(*fields)
    text = F.coalesce(found, payload, F.lit(""))
    omitted = F.when(found.isNotNull(), F.greatest(F.size(F.json_object_keys(payload)) - 1, F.lit(0))).otherwise(0)
    return F.struct(F.substring(text, 1, most).alias("snippet"), (F.length(text) > most).alias("truncated"), omitted.alias("omitted"))


def sentences_with(text: Column, pattern: str, most: int = 2) -> Column:
    """The first sentences that match."""
    parts = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda s: (s != "") & s.rlike(pattern)), 1, most)


def named_company(title: Column, suffixes: list[str] = LEGAL_FORMS) -> Column:
    """What stands before the first semicolon, if it reads as a company: 80 characters, two words, a corporate word."""
    part = F.trim(F.substring_index(title, ";", 1))
    tokens = F.filter(F.transform(F.split(part, r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"(?U)[^\w]", ""))), lambda t: t != "")
    fine = (F.instr(title, ";") > 0) & (F.length(part) <= 80) & (F.size(tokens) >= 2) & F.arrays_overlap(tokens, F.array(*map(F.lit, suffixes)))
    return F.when(fine, part)


def terms_absent(text: Column, terms: list[str]) -> Column:
    """Whether none of the terms occurs as whole words, letter case aside."""
    out = F.lit(True)
    for t in terms:
        out = out & ~F.coalesce(text, F.lit("")).rlike(rf"(?iU)\b\Q{t}\E\b")
    return out


def docket_tokens(docket_ids: Column) -> Column:
    """Distinct rulemaking dockets named in an array of strings."""
    return F.array_distinct(F.flatten(F.transform(docket_ids, lambda x: F.regexp_extract_all(x, F.lit(r"(RM\d+-\d+-\d+)"), 1))))


def standard_ids(text: Column) -> Column:
    """Distinct CIP standard numbers in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"CIP-(\d{3})"), 1))


def identity_safe_url(url: Column, scope: Column) -> Column:
    """On rows that name nobody a tracker's permalink becomes the tracker's index."""
    value = F.trim(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.lower(F.try_parse_url(value, F.lit("HOST"))), r"^www\.", "")
    listed = F.coalesce(host.isin(TRACKER_HOSTS), F.lit(False)) & ~F.coalesce(scope.isin(PUBLIC_SCOPES), F.lit(False))
    return F.when(listed, TRACKER_INDEX).otherwise(value)


def clickable_url(url: Column) -> Column:
    """http and https urls; else null."""
    value = F.trim(url)
    return F.when(F.lower(F.regexp_extract(value, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).isin("http", "https"), value)


def public_key(value: Column) -> Column:
    """Sixteen hex digits that stand for an id."""
    return F.substring(F.sha2(value, 256), 1, 16)


def event_reference(raw_event_id: Column, scope: Column) -> Column:
    """struct(ref, hashed): the id itself where the row names its entity anyway, else its public key."""
    value = F.trim(F.coalesce(raw_event_id, F.lit("")))
    hashed = (value != "") & ~F.coalesce(scope.isin(PUBLIC_SCOPES), F.lit(False))
    return F.struct(F.when(hashed, public_key(value)).otherwise(value).alias("ref"), hashed.alias("hashed"))


def severity_band(score: Column) -> Column:
    return F.when(score >= 4, "critical").when(score >= 2.75, "high").when(score >= 1.5, "moderate").otherwise("low")


def density_band(count: Column) -> Column:
    """On a fixed scale: 0, up to 2, up to 6, up to 14, more."""
    n = F.coalesce(count, F.lit(0))
    return F.when(n <= 0, "d0").when(n <= 2, "d1").when(n <= 6, "d2").when(n <= 14, "d3").otherwise("d4")


def is_peer_industry(tag: Column) -> Column:
    return squeezed(F.lower(F.replace(F.coalesce(tag, F.lit("")), F.lit("&"), F.lit("and")))).isin(PEER_INDUSTRIES)


def customer_facing(tier: Column) -> Column:
    """Unconfirmed warnings never face a customer."""
    return F.when(tier == "unconfirmed_early_warning", 0).otherwise(1)


def list_cell(cell: Column) -> Column:
    """A list from a cell that holds a JSON array, values between semicolons or one value."""
    values = F.coalesce(F.when(F.ltrim(cell).startswith("["), F.from_json(cell, "array<string>")), F.split(cell, ";"), F.array().cast("array<string>"))
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
