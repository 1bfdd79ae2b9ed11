"""Measurements of sources: how rich, how near, how dear."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .terms import named_terms


def richness(rows: DataFrame, by: str, text: str, short: int = 6) -> DataFrame:
    """Per group: rows, mean and median words, and the share of rows with fewer than `short` words."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    per = rows.withColumn("_n", n).groupBy(by)
    return per.agg(F.count("*").alias("rows"), F.round(F.avg("_n"), 6).alias("mean_words"), F.median("_n").alias("median_words"), F.round(F.count_if(F.col("_n") < short) / F.count("*"), 6).alias("short_share"))


def goldens_met(goldens: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per golden (golden_id, expected map) whether every pinned check equals its verdict; a missing verdict fails."""
    pinned = goldens.select("golden_id", F.explode("expected").alias("check_type", "want"))
    rows = pinned.join(verdicts, ["golden_id", "check_type"], "left")
    return rows.groupBy("golden_id").agg(F.bool_and(F.coalesce(F.col("want") == F.col("result"), F.lit(False))).alias("met"), F.count_if(F.col("result").isNull()).alias("errors"))


def price_at(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call (model, day, chars, max_out) with its estimated cost at the price in force that day."""
    until = F.lead("start").over(Window.partitionBy("model").orderBy("start"))
    p = prices.dropDuplicates(["model", "start"]).select(F.col("model").alias("_m"), "start", until.alias("_until"), "per_million_in", "per_million_out")
    in_force = (F.col("start") <= F.col("day")) & (F.col("_until").isNull() | (F.col("day") < F.col("_until")))
    met = calls.join(p, (F.col("model") == F.col("_m")) & in_force, "left")
    return met.select(*calls.columns, F.round((F.col("chars") / 4 * F.col("per_million_in") + F.col("max_out") * F.col("per_million_out")) / 1e6, 9).alias("cost"))


#: The level of boxes without a finite size.
UNBOUNDED = 2000


def located(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (id, x, y) with the smallest box (region, x0, y0, x1, y1; sides included) around them; those outside all are left out.

    Each box is of the level whose grid cells (powers of two) are just as wide as its longer side, so it meets at most four of
    them; a point looks into its own cell of every level that has boxes. Of boxes as small as each other the first region counts. A row of
    points that is repeated has a row each; points and boxes with a null or NaN side meet nothing.
    """
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    real = [~F.isnan(F.col(c).cast("double")) for c in ("x0", "y0", "x1", "y1")]
    sound = boxes.where((width >= 0) & (height >= 0) & real[0] & real[1] & real[2] & real[3])
    side = F.greatest(width, height, F.lit(1e-9)).cast("double")
    level = F.when(side < 1e300, F.ceil(F.log2(side)).cast("int")).otherwise(UNBOUNDED)
    cell = lambda v, n: F.when(n == UNBOUNDED, F.lit(0.0)).otherwise(F.floor(F.col(v).cast("double") / F.pow(F.lit(2.0), n.cast("double"))).cast("double"))
    sized = sound.withColumn("_level", level)
    n = F.col("_level")
    both = lambda v: F.array_distinct(F.array(cell(f"{v}0", n), cell(f"{v}1", n)))
    listed = sized.withColumn("_cx", F.explode(both("x"))).withColumn("_cy", F.explode(both("y")))
    levels = sized.agg(F.array_sort(F.collect_set("_level")).alias("_levels"))  # some dozens of numbers
    rows = points.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(levels), F.lit(True)).withColumn("_level", F.explode("_levels")).drop("_levels")
    rows = rows.withColumns({"_cx": cell("x", n), "_cy": cell("y", n)})
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    met = rows.join(listed, ["_level", "_cx", "_cy"]).where(inside & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double")))
    return met.groupBy(*points.columns, "_row").agg(F.min_by("region", F.struct(width * height, F.col("region"))).alias("region")).drop("_row")


def term_hits(titles: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """Watchlist terms in each title, longest first and apart, in order of appearance, each once."""
    hits = named_terms(titles.sparkSession, F.col(text), terms)
    rows = titles.select(key, hits.alias("terms"))
    return rows.withColumn("terms", F.array_distinct(F.transform("terms", lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", " "))))).where(F.size("terms") > 0)


# An agency, what its documents must be about, and what they must order.
RELEVANT_AGENCY = "transportation security administration"
RELEVANT_TOPICS = ["pipeline", "lng", "liquefied natural gas"]
RELEVANT_TERMS = ["security directive", "cybersecurity", "cyber security", "security program", "security measures", "security requirements"]


def relevance(documents: DataFrame, by: str, cutoff: str) -> DataFrame:
    """Per `by` how many documents (event_date, JSON payload) are of the agency, on a topic and with a term, in the window from `cutoff` on.

    malformed: payloads that are no JSON object; a blank one is an object without fields. Of the relevant ones undated_matches have no ISO date and
    out_of_window_matches an earlier one; the rest are match_count. recommendation: reuse, none, or widen (none, but relevant ones before the window).
    """
    said = F.coalesce(F.nullif("payload", F.lit("")), F.lit("{}"))
    whole = F.try_parse_json(said)
    rows = documents.withColumns({"_whole": whole, "_sound": F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))})
    field = lambda n: F.coalesce(F.get_json_object(said, f"$.{n}"), F.lit(""))
    text = F.lower(F.concat_ws(" ", field("title"), field("abstract"), field("action")))
    names = lambda words: F.exists(F.lit(words), lambda w: F.contains(text, w))
    relevant = F.col("_sound") & F.contains(F.lower(field("agency_names")), F.lit(RELEVANT_AGENCY)) & names(RELEVANT_TOPICS) & names(RELEVANT_TERMS)
    dated = F.coalesce(F.col("event_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    early = F.col("event_date") < cutoff
    out = rows.withColumns({"_r": relevant, "_d": dated}).groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(~F.col("_sound")).alias("malformed"), F.count_if(F.col("_r") & ~F.col("_d")).alias("undated_matches"),
        F.count_if(F.col("_r") & F.col("_d") & early).alias("out_of_window_matches"), F.count_if(F.col("_r") & F.col("_d") & ~early).alias("match_count"),
    )
    return out.withColumn("recommendation", F.when(F.col("match_count") > 0, "reuse").when(F.col("out_of_window_matches") > 0, "widen").otherwise("none"))
