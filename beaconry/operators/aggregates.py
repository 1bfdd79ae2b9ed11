"""Stored aggregates that are replaced together with their state row, and what tells whether they still hold.

An aggregate's counts are written first, into a folder of their own. One row is then appended to the pointer: the state and the
name of that folder. It is one file, which Spark's writer moves into place whole, so a reader finds the old pair or the new one, whatever
fails in between. Counts that no pointer names are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .worklists import staleness

POINTER = "n bigint, version string, as_of string, filters string, basis string"


def pointed(spark: SparkSession, folder: str) -> DataFrame:
    """The pointer's last row: of several writers at once the last by number, then by name; no row before the first replacement."""
    try:
        rows = spark.read.schema(POINTER).parquet(f"{folder}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)
    return rows.agg(F.max(F.struct("n", "version", "as_of", "filters", "basis")).alias("r")).where("r is not null").select("r.*")


def replace(counts: DataFrame, folder: str, as_of: str, filters: str, basis: str | None) -> None:
    """Replaces the aggregate below `folder` and its state together."""
    spark, version = counts.sparkSession, uuid.uuid4().hex
    counts.write.parquet(f"{folder}/counts-{version}")
    last = pointed(spark, folder).first()
    row = [((last["n"] if last else 0) + 1, version, as_of, filters, basis)]
    spark.createDataFrame(row, POINTER).coalesce(1).write.mode("append").parquet(f"{folder}/pointer")


def served(spark: SparkSession, folder: str, live: Callable[[], DataFrame], filters: str, basis: str | None, now: str, most_hours: float = 26.0) -> DataFrame:
    """The stored counts if their state is fresh, else what `live` gives, with columns reason ('' if stored) and as_of.

    The one state row is read first: nothing live is planned while the store is fresh, and nothing stored is read while it isn't.
    """
    one = spark.range(1).join(pointed(spark, folder), F.lit(True), "left")
    state = one.select("version", "as_of", staleness(filters, basis, now, most_hours).alias("reason")).first()
    if state["reason"]:
        return live().withColumns({"reason": F.lit(state["reason"]), "as_of": F.lit(now)})
    return spark.read.parquet(f"{folder}/counts-{state['version']}").withColumns({"reason": F.lit(""), "as_of": F.lit(state["as_of"])})


def filter_key(statuses: list[str]) -> str:
    """One form for a filter of statuses, in whichever order they are named."""
    return ",".join(sorted(set(statuses)))


def live_counts(signals: DataFrame, triggers: DataFrame, statuses: list[str]) -> DataFrame:
    """dimension, key, label and n of signals with these statuses by trigger, scope and tier. A null tier is no bucket; a trigger's name is its label."""
    rows = signals.where(F.col("status").isin(statuses))
    keys = {"trigger": "trigger_id", "scope": "signal_scope", "incident_tier": "tier"}
    kinds = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("key")) for d, c in keys.items()))).alias("k")
    per = rows.select(kinds).select("k.*").where("dimension <> 'incident_tier' or key is not null").groupBy("dimension", "key").agg(F.count("*").alias("n"))
    names = triggers.select(F.lit("trigger").alias("dimension"), F.col("trigger_id").alias("key"), F.col("name").alias("label"))
    return per.join(names, ["dimension", "key"], "left").select("dimension", "key", F.coalesce("label", "key").alias("label"), "n")


def fingerprint(signals: DataFrame, edits: DataFrame) -> DataFrame:
    """One row, `basis`: canonical JSON of the signals per status (null as '') and the largest edit_id, null where there is none."""
    per = signals.groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"))
    counts = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))  # a row a status
    both = counts.join(edits.agg(F.max("edit_id").alias("max_tier_edit")), F.lit(True))  # one row each
    return both.select(F.to_json(F.struct("max_tier_edit", "status_counts"), {"ignoreNullFields": "false"}).alias("basis"))


def probe(events: DataFrame, signals: DataFrame, reviews: DataFrame, edits: DataFrame, window_source: str) -> DataFrame:
    """section, a, b, c, n, first and last: the store at a glance.

    source: events and newest date by source. signals: by trigger, scope and tier ('n/a' if null). triggers: entities with two distinct triggers
    and more. window: oldest and newest date of one source's events. pending: reviews that wait. edits: tier edits. The last
    three have a row only if they count something. Null keys read '(null)'.
    """
    none = F.lit(None).cast("string")
    named = lambda c, blank="(null)": F.coalesce(F.col(c).cast("string"), F.lit(blank))
    row = lambda df, section, a=none, b=none, c=none, first=none, last=none: df.select(F.lit(section).alias("section"), a.alias("a"), b.alias("b"), c.alias("c"), "n", first.alias("first"), last.alias("last"))
    n = F.count("*").alias("n")
    day = F.nullif(F.col("event_date"), F.lit(""))
    parts = [
        row(events.groupBy(named("source_id").alias("a")).agg(n, F.max(day).alias("l")), "source", F.col("a"), last=F.col("l")),
        row(signals.groupBy(named("trigger_id").alias("a"), named("signal_scope").alias("b"), named("tier", "n/a").alias("c")).agg(n), "signals", F.col("a"), F.col("b"), F.col("c")),
        row(signals.where("entity_id is not null").groupBy(F.col("entity_id").cast("string").alias("a")).agg(F.count_distinct("trigger_id").alias("n")).where("n >= 2"), "triggers", F.col("a")),
        row(events.where(F.col("source_id") == window_source).agg(n, F.min(day).alias("f"), F.max(day).alias("l")).where("n > 0"), "window", F.lit(window_source), first=F.col("f"), last=F.col("l")),
        row(reviews.where("disposition = 'pending'").agg(n).where("n > 0"), "pending"),
        row(edits.agg(n).where("n > 0"), "edits"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
