"""The batch operators driven by Structured Streaming.

State by key is Spark's own (a streaming aggregation in the state store); what a micro-batch changes is written as rows of its
own, under its number, so nothing is rewritten as the state grows and a batch that is repeated replaces its own rows only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.classify import identified, merged, reconciled

#: Column with a micro-batch's number in a change log.
BATCH = "batch"


def file_stream(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    """The files of a folder as a stream, so many a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


class ChangeLog:
    """Rows by micro-batch in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def write(self, rows: DataFrame, n: int) -> None:
        """A micro-batch's rows. Written again, they replace themselves."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/changes/{BATCH}={n}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their batch, or those before a batch's number."""
        try:
            rows = self.spark.read.schema(f"{self.schema}, {BATCH} bigint").parquet(f"{self.folder}/changes")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.schema}, {BATCH} bigint")
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def latest(self, key: str, before: int | None = None, by: str | None = None, only: DataFrame | None = None) -> DataFrame:
        """Each key's last row, without the batch; with `by` and `only`, of those rows whose `by` is one of `only`'s."""
        rows = self.read(before)
        if by is not None:
            rows = rows.join(merged(only.select(by).distinct()), by, "left_semi")
        rest = [c for c in rows.columns if c not in (key, BATCH)]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), BATCH).alias("_r"))
        return last.select(key, "_r.*").select([c for c in rows.columns if c != BATCH])


def upserts(events: DataFrame, key: str, order: list[str], kept: list[str], touched: list[str]) -> DataFrame:
    """Keyed upserts as a streaming aggregation: per key the `kept` columns as first met and the `touched` ones as last met, by `order`.

    `order` begins with what tells deliveries apart (a run's number or time); then the result doesn't depend on how they are split into batches.
    """
    at = F.struct(*order)
    met = events.groupBy(key).agg(F.min_by(F.struct(*kept), at).alias("f"), F.max_by(F.struct(*touched), at).alias("l"))
    return met.select(key, *(F.col(f"f.{c}").alias(c) for c in kept), *(F.col(f"l.{c}").alias(c) for c in touched))


def upsert_stream(events: DataFrame, log: ChangeLog, checkpoint: str, key: str, order: list[str], kept: list[str], touched: list[str]) -> StreamingQuery:
    """Runs keyed upserts over what a stream has now: each micro-batch logs the keys that it met, as they are after it."""
    rows = upserts(events, key, order, kept, touched)
    return rows.writeStream.foreachBatch(log.write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What the log of signals has besides the rule's own columns, and the ledger of deliveries.
LOGGED, LEDGER = ("signal_id", "raw_event_id", "status", "change"), "raw_event_id string, delivered bigint"


def classify_stream(events: DataFrame, rule: Callable[[DataFrame], DataFrame], log: ChangeLog, ledger: ChangeLog, checkpoint: str, dismissed: DataFrame | None = None) -> StreamingQuery:
    """Applies a rule to the events of a stream and logs how its signals change: new, retracted, restored or refreshed.

    `delivered` numbers an event's deliveries (a run's number or time). A signal is active if its event's last delivery gives it, and
    retracted if only others do, however the deliveries are split into batches and in whichever order those come. Signals of events that aren't
    delivered stay as they are; those in `dismissed` (signal_id) are dismissed and never touched. A row that repeats a delivery counts once.
    The log has signal_id, raw_event_id, the rule's columns that its schema names (as the last delivery that counts gave them), status and change.
    """

    def step(batch: DataFrame, n: int) -> None:
        rows = counted_rows(batch.where("raw_event_id is not null"), ledger, n).persist()
        now = given(rows.where("_counts"), rule, log).persist()  # rules are dear and its columns are read several times
        try:
            log.write(signal_changes(rows, now, rule, log, n, dismissed), n)
            ledger.write(rows.groupBy("raw_event_id").agg(F.max("delivered").alias("delivered")), n)
        finally:
            now.unpersist()
            rows.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_rows(batch: DataFrame, ledger: ChangeLog, n: int) -> DataFrame:
    """The rows of micro-batch n with `_last` (one row of the event's last delivery yet) and `_counts` (that, with a number). The ledger is looked up for its events only."""
    place = F.row_number().over(Window.partitionBy("raw_event_id").orderBy(F.desc("delivered")))
    ids = batch.select("raw_event_id").distinct()
    seen = ledger.read(before=n).join(merged(ids), "raw_event_id", "left_semi").groupBy("raw_event_id").agg(F.max("delivered").alias("_seen"))
    rows = batch.withColumn("_n", place).join(merged(seen), "raw_event_id", "left")
    rows = rows.withColumn("_last", (F.col("_n") == 1) & F.coalesce(F.col("delivered") >= F.col("_seen"), F.lit(True)))
    return rows.withColumn("_counts", F.col("_last") & F.col("delivered").isNotNull()).drop("_n", "_seen")


def given(rows: DataFrame, rule: Callable[[DataFrame], DataFrame], log: ChangeLog) -> DataFrame:
    """The signals that a rule gives for rows, with those of its columns that the log has."""
    fields = [c.split()[0] for c in log.schema.split(", ")]
    return identified(rule(rows.drop("_last", "_counts"))).select("signal_id", "raw_event_id", *(c for c in fields if c not in LOGGED))


def signal_changes(rows: DataFrame, now: DataFrame, rule: Callable[[DataFrame], DataFrame], log: ChangeLog, n: int, dismissed: DataFrame | None = None) -> DataFrame:
    """The rows that micro-batch n (its `counted_rows`, and `now`: what those that count give) adds to the log of signals. Of the log only rows of its own events are looked up.

    All sides grow with the batch, and the log's files are far smaller than their rows: no side is ever broadcast.
    """
    columns = [c.split()[0] for c in log.schema.split(", ")]
    fields = [c for c in columns if c not in LOGGED]
    # Rows that don't count only add signals that no other gave, as retracted ones.
    counting, rest = rows.where("_last").select("raw_event_id"), given(rows.where("not _counts"), rule, log)
    before = log.latest("signal_id", before=n, by="raw_event_id", only=rows).drop("change")
    if dismissed is not None:
        before, now, rest = (x.join(merged(dismissed.select("signal_id")), "signal_id", "left_anti") for x in (before, now, rest))

    fresh = now.join(merged(before), "signal_id", "left_anti").withColumns({"status": F.lit("active"), "change": F.lit("new")})
    lost = rest.join(merged(now), "signal_id", "left_anti").join(merged(before), "signal_id", "left_anti").withColumns({"status": F.lit("retracted"), "change": F.lit("retracted")})
    again = now.select("signal_id", F.struct(*fields).alias("_now"))
    known = reconciled(before.withColumn("_was", F.col("status")), counting, now).join(merged(again), "signal_id", "left")
    change = F.when(F.col("status") != F.col("_was"), F.when(F.col("status") == "retracted", "retracted").otherwise("restored")).when(~F.col("_now").eqNullSafe(F.struct(*fields)), "refreshed")
    known = known.withColumn("change", F.when(F.col("_now").isNotNull() | (F.col("status") != F.col("_was")), change)).where("change is not null")
    known = known.withColumns({f: F.when(F.col("_now").isNotNull(), F.col(f"_now.{f}")).otherwise(F.col(f)) for f in fields})
    return fresh.select(columns).unionByName(lost.select(columns)).unionByName(known.select(columns))


def daily_counts(events: DataFrame, late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Counts per day and `by` of a stream with a watermark, in append mode: a day is given once no event of it counts any more."""
    day = F.window("ts", "1 day").alias("w")
    return events.withWatermark("ts", late).groupBy(day, by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), by, "n")


COUNTED, LATEST = "day timestamp, {by} string, n bigint", "top timestamp"


def count_stream(events: Callable[[], DataFrame], folder: str, late: str = "2 days", by: str = "event_type") -> None:
    """Counts what a stream has now by day: closed days in one log below `folder`, rows that came after their day was closed in another.

    `events` gives the stream anew for each of the two queries; both see the same micro-batches. A day is closed when it ends before
    the latest time of all earlier micro-batches less `late`, which is where the watermark stands; a run with an earlier run's
    folder goes on from there. Rows without a time count nowhere.
    """
    spark = events().sparkSession
    closed, tardy, tops = (ChangeLog(spark, f"{folder}/{name}", schema) for name, schema in (("closed", COUNTED.format(by=by)), ("late", COUNTED.format(by=by)), ("tops", LATEST)))
    run = lambda rows, step, name, mode: rows.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{folder}/{name}-query").trigger(availableNow=True).start().awaitTermination()

    def tardy_rows(batch: DataFrame, n: int) -> None:
        mark = tops.read(before=n).agg((F.max("top") - F.expr(f"interval '{late}'")).alias("mark")).first()["mark"]
        day = F.window("ts", "1 day")
        behind = batch.where("ts is not null").where(day["end"] <= F.lit(mark)) if mark is not None else batch.limit(0)
        tardy.write(behind.groupBy(day["start"].alias("day"), by).agg(F.count("*").alias("n")), n)
        tops.write(batch.agg(F.max("ts").alias("top")), n)

    run(daily_counts(events(), late, by), closed.write, "closed", "append")
    run(events(), tardy_rows, "late", "append")


def counted(spark: SparkSession, folder: str, by: str = "event_type") -> DataFrame:
    """day, `by`, n (counted in time) and late of the closed days of a count_stream's folder."""
    read = lambda name: ChangeLog(spark, f"{folder}/{name}", COUNTED.format(by=by)).read().groupBy("day", by).agg(F.sum("n").alias("n"))
    both = read("closed").join(read("late").withColumnRenamed("n", "late"), ["day", by], "full_outer")
    return both.select("day", by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("late", F.lit(0)).alias("late"))
