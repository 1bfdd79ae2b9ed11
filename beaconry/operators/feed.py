"""Ranked feeds, run health, duplicate candidates and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_page(rows: DataFrame, after: tuple[str, str] | None = None, limit: int = 25) -> DataFrame:
    """A page by date and id, newest first, strictly after a key; one row more than `limit` tells of a next page."""
    if after:
        rows = rows.where((F.col("event_date") < after[0]) | ((F.col("event_date") == after[0]) & (F.col("signal_id") < after[1])))
    return rows.orderBy(F.desc("event_date"), F.desc("signal_id")).limit(limit + 1)


def run_health(runs: DataFrame, keys: list[str], ok: Column, order: list[str], carry: list[str]) -> DataFrame:
    """The last and the last successful run per key, in one aggregation."""
    what = F.struct(*carry)
    rank = F.struct(*order)
    return runs.groupBy(*keys).agg(
        F.max_by(what, rank).alias("last"),
        F.max_by(F.when(ok, what), F.when(ok, rank)).alias("last_ok"),
        F.count("*").alias("runs"),
        F.count_if(~ok).alias("errors"),
    )


def source_state(enabled: Column, has_run: Column, failed: Column, age_s: Column, ttl_s: Column) -> Column:
    return F.when(~enabled, "disabled").when(~has_run, "never_run").when(failed, "error").when(age_s > ttl_s, "stale").otherwise("ok")


def near_in_time(rows: DataFrame, days: int = 3) -> DataFrame:
    """Pairs of one entity and trigger whose dates differ by `days` at most; rows without a date are left out.

    Dates fall into bins of `days` + 1 days; a row meets its own bin and the next, so a busy entity's rows
    meet only their neighbours in time, and the join's key is (entity, trigger, bin).
    """
    width = days + 1
    base = rows.where("day is not null and entity_id is not null").select("signal_id", "entity_id", "trigger_id", "day", F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / width).alias("bin"))
    left = base.select("entity_id", "trigger_id", F.col("signal_id").alias("x"), F.col("day").alias("dx"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"), F.col("bin").alias("own"))
    right = base.select("entity_id", "trigger_id", F.col("signal_id").alias("y"), F.col("day").alias("dy"), "bin")
    gap = F.abs(F.datediff("dy", "dx"))
    once = (F.col("own") < F.col("bin")) | (F.col("x") < F.col("y"))
    pairs = left.join(right, ["entity_id", "trigger_id", "bin"]).where(once & (F.col("x") != F.col("y")) & (gap <= days))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), gap.alias("gap"))


def same_content(rows: DataFrame, most_listed: int = 50) -> DataFrame:
    """Rows of groups with equal content hashes: each with its group's first row, which stands for the group.

    Groups are aggregated and joined back, so a group of any size costs its rows, not their pairs.
    """
    first = rows.groupBy("content_hash").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(first, "content_hash").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))


def duplicate_candidates(near: DataFrame, equal: DataFrame) -> DataFrame:
    """One row per pair: its bases, the day gap and a rank; content beats time."""
    rows = near.select("a", "b", F.lit("near_date").alias("basis"), "gap", F.lit(1).alias("rank")).unionByName(equal.select("a", "b", F.lit("same_content").alias("basis"), F.lit(None).cast("int").alias("gap"), F.lit(0).alias("rank")))
    return rows.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("basis")), "+").alias("bases"), F.min("gap").alias("gap"), F.min("rank").alias("rank"))


def round_robin_sample(rows: DataFrame, stratum: str, key: str, seed: int, limit: int) -> DataFrame:
    """One row of each stratum in turn, in an order that the seed gives, up to `limit` rows.

    No stratum gives more than `limit` rows, so ranks beyond it are dropped before the final sort.
    """
    order = F.sha2(F.concat_ws("|", F.col(key), F.lit(str(seed))), 256)
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", stratum).limit(limit)


def counts_by(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts by each of some dimensions in one pass: dimension, key, count; nulls aren't a key."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions))
    tall = rows.select(F.explode(pairs).alias("p")).select("p.*").where("key is not null")
    return tall.groupBy("dimension", "key").agg(F.count("*").alias("count"))


def previous_by(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Adds the value of the same key strictly before each row's order; rows with equal order don't see each other."""
    w = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))
