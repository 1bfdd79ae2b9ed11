"""Activity counts that name nobody unless several are behind a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_crew(rows: DataFrame, least_victims: int = 2) -> DataFrame:
    """Crews by volume; one with fewer distinct victims than `least_victims` (case and blanks aside) is only counted."""
    victim = F.lower(F.trim(F.regexp_replace("victim", r"\s+", " ")))
    per = rows.groupBy("crew").agg(F.count("*").alias("listings"), F.count_distinct(victim).alias("victims"))
    named = per.where(F.col("victims") >= least_victims).select("crew", "listings", F.lit(1).cast("bigint").alias("crews"))
    withheld = per.where(F.col("victims") < least_victims).agg(F.sum("listings").alias("listings"), F.count("*").alias("crews"))
    return named.unionByName(withheld.where("crews > 0").select(F.lit("(withheld)").alias("crew"), "listings", "crews"))


def by_industry(rows: DataFrame, is_peer: Column) -> DataFrame:
    """Industries with their rank in the world, and whether they are the watchlist's own; a blank one isn't ranked."""
    per = rows.where(F.coalesce("industry", F.lit("")) != "").groupBy("industry").agg(F.count("*").alias("listings"))
    # One row per industry: a short list.
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("listings"), "industry"))).withColumn("peer", is_peer)


def halves(daily: DataFrame, least_interior: int = 2) -> DataFrame:
    """Two equal halves of the covered days, without the first and last and an odd middle one: totals and change.

    `daily` has day, total and peer, one row a day.
    """
    n = daily.agg(F.count("*").alias("n")).select("n")
    numbered = daily.withColumn("i", F.row_number().over(Window.orderBy("day")) - 1).crossJoin(F.broadcast(n))  # n is one row
    half = F.floor((F.col("n") - 2) / 2)
    inner = (F.col("n") - 2) >= least_interior
    side = F.when(inner & F.col("i").between(1, half), "prior").when(inner & (F.col("i") >= F.col("n") - 1 - half) & (F.col("i") <= F.col("n") - 2), "current")
    rows = numbered.withColumn("side", side)
    pick = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0)).cast("bigint")
    out = rows.agg(
        F.count("*").alias("covered_days"),
        F.count_if(F.col("side") == "prior").alias("half_days"),
        *(pick(s, c).alias(f"{s}_{c}") for s in ("prior", "current") for c in ("total", "peer")),
    )
    fine = F.col("half_days") > 0
    seen = fine & (F.col("prior_peer") + F.col("current_peer") > 0)
    return out.withColumns(
        {
            "available": fine,
            "subject_available": seen,
            "total_delta": F.when(fine, F.col("current_total") - F.col("prior_total")),
            "peer_delta": F.when(fine, F.col("current_peer") - F.col("prior_peer")),
        }
    )
