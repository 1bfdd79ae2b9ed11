"""Dates that are text, as feeds deliver them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(text: Column) -> Column:
    """The date of an ISO date or timestamp text; null unless it starts with a whole date."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def age_days(text: Column, now: date) -> Column:
    """Whole days up to `now`; unreadable and future dates count as today."""
    return F.greatest(F.coalesce(F.datediff(F.lit(now), day_of(text)), F.lit(0)), F.lit(0))


def in_window(text: Column, cutoff: str, keep_undated: bool) -> Column:
    """Dates not before `cutoff`, compared as text; blank ones stay or go by policy."""
    value = F.coalesce(text, F.lit(""))
    return (value >= cutoff) | (value == "") if keep_undated else value >= cutoff


def trailing_cutoff(now: Column, months: int = 24) -> Column:
    """The same day so many months ago; a leap day falls back to the 28th."""
    return F.add_months(now, -months)


def short_us_date(text: Column) -> Column:
    """M/D/YY or M/D/YYYY; two-digit years up to 49 are of this century."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$", i)
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3) <= "49", F.concat(F.lit("20"), part(3))).otherwise(F.concat(F.lit("19"), part(3)))
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", year, F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd"))


def span_days(first: Column, last: Column) -> Column:
    """Days from first to last, both counted."""
    return F.datediff(last, first) + 1
