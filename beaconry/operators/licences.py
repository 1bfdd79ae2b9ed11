"""Licence facts from a price matrix, their refresh, and candidates of plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state

#: What a refresh takes from the matrix; all else of a stored fact is its editor's.
IDENTITY = ["product_id", "sku_or_plan", "segment"]
EDITABLE = ["price_note", "included_or_addon", "prerequisite", "effective_date", "verified_date", "source_quality", "source_url"]


def government_note(cell: Column) -> Column:
    """The price note of a free-text cell on government clouds, null for a blank one; the cell's text follows a prefix."""
    raw = F.regexp_replace(F.coalesce(cell, F.lit("")), r"^\s+|\s+$", "")
    low = F.lower(raw)
    no = (low == "no") | low.startswith("no ") | low.startswith("no(")
    prefix = F.when(low.startswith("yes"), "available").when(no, "not available").otherwise("needs_curation")
    return F.when(raw != "", F.concat(prefix, F.lit(" — "), raw))


def facts(matrix: DataFrame, families: DataFrame, prerequisites: DataFrame) -> DataFrame:
    """A commercial fact per matrix row, and one of the government cloud where the cell `gcc_high` isn't blank.

    `families` (sku, family) names every sku once, suites with a null family; a sku that it doesn't name ends the job with an
    error. `prerequisites` has tier and prerequisite; a tier without one has ''. An empty matrix gives no facts.
    """
    rows = matrix.join(families.select(F.col("sku").alias("product_id"), "family", F.lit(True).alias("_mapped")), "product_id", "left").join(prerequisites, "tier", "left")
    unmapped = F.raise_error(F.concat(F.lit("no family for the sku "), F.coalesce("product_id", F.lit("null")))).cast("string")
    sku = F.concat_ws(":", "product_id", "tier")
    kinds = F.array(
        F.struct(F.lit("commercial").alias("segment"), F.col("addon_price_note").alias("note")),
        F.struct(F.lit("gcc_high").alias("segment"), government_note(F.col("gcc_high")).alias("note")),
    )
    made = F.filter(kinds, lambda x: (x["segment"] == "commercial") | x["note"].isNotNull())
    rows = rows.select("*", sku.alias("sku_or_plan"), F.explode(made).alias("kind"))
    return rows.select(
        F.concat_ws(":", "sku_or_plan", "kind.segment").alias("fact_id"),
        F.when(F.col("_mapped"), F.col("family")).otherwise(unmapped).alias("product_id"),
        "sku_or_plan",
        F.col("kind.segment").alias("segment"),
        F.col("kind.note").alias("price_note"),
        "included_or_addon",
        F.coalesce("prerequisite", F.lit("")).alias("prerequisite"),
        F.lit("").alias("effective_date"),
        *EDITABLE[4:],
    )


def refreshed_facts(stored: DataFrame, produced: DataFrame, cited: DataFrame) -> DataFrame:
    """Stored facts after a rebuild: known ones get the identity columns only, new ones come whole.

    Facts of the matrix (those with a sku_or_plan) that are no longer produced go, unless `cited` (fact_id) has them; an
    operator's own facts stay.
    """
    owned = stored.where(F.col("sku_or_plan").isNotNull()).select("fact_id")
    stale = owned.join(produced.select("fact_id"), "fact_id", "left_anti").join(cited.select("fact_id"), "fact_id", "left_anti")
    return state.refreshed(stored, produced, "fact_id", IDENTITY, EDITABLE).join(stale, "fact_id", "left_anti")


def refreshed_candidates(stored: DataFrame, indicators: DataFrame, paths: DataFrame, names: DataFrame, snapshots: DataFrame, question: str) -> DataFrame:
    """Candidates, one per trigger and family of `indicators`, and `stale` ones, which stay only if a snapshot has their play_id.

    `paths` has product_id and recommended_path, `names` product_id and name; a family without a path ends the job with an
    error. `question` is a format with the path and the name. Repeated indicators count once.
    """
    pairs = indicators.select("trigger_id", "product_id").distinct()
    rows = pairs.join(paths.select("product_id", "recommended_path", F.lit(True).alias("_path")), "product_id", "left").join(names, "product_id", "left")
    missing = F.raise_error(F.concat(F.lit("no path for the family "), F.coalesce("product_id", F.lit("null")))).cast("string")
    made = rows.select(
        F.concat_ws(":", "trigger_id", "product_id").alias("play_id"),
        "trigger_id",
        "product_id",
        F.when(F.col("_path"), F.col("recommended_path")).otherwise(missing).alias("recommended_path"),
        F.format_string(question, "recommended_path", "name").alias("discovery_question"),
        F.lit(False).alias("stale"),
    )
    old = stored.join(made.select("play_id"), "play_id", "left_anti").join(snapshots.select("play_id"), "play_id", "left_semi")
    return made.unionByName(old.withColumn("stale", F.lit(True)).select(made.columns))
