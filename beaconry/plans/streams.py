"""Streaming forms of keyed upserts, rules and daily counts, run over all events in several deliveries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..session import new_dir, table
from ..streaming import ingest

#: All files of a delivery in one micro-batch.
WHOLE = 1 << 20


def t01_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, the first two thirds in one run and the last two in the next, upserted by key from a stream."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "props").alias("key"), "event_id", F.col("value").alias("payload"))
    top = e.agg(F.max("event_id").alias("top"))
    e = e.join(F.broadcast(top), F.lit(True))  # one row
    folder = new_dir(spark, "upserts")
    log = ingest.ChangeLog(spark, f"{folder}/state", "key string, payload double, first_seen bigint, last_seen bigint")
    for run, part in enumerate(("3 * event_id <= 2 * top", "3 * event_id > top")):
        rows = e.where(part).select(F.lit(run).alias("run"), "key", "event_id", "payload", F.col("event_id").alias("first_seen"), F.col("event_id").alias("last_seen"))
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = ingest.file_stream(spark, f"{folder}/in", rows.schema)
        ingest.upsert_stream(stream, log, f"{folder}/checkpoint", "key", ["run", "event_id"], ["payload", "first_seen"], ["last_seen"]).awaitTermination()
    return log.latest("key")


TITLES = {
    1: ("true", "CASE WHEN k % 3 = 0 THEN 'Norwind confirms data breach' ELSE 'Rain' END"),
    2: ("k % 2 = 0", "CASE WHEN k % 4 = 0 THEN 'Rain' ELSE 'Sudwind reports cyber-attack' END"),
    3: ("k % 24 = 0", "'Norwind confirms data breach'"),
}


def t02_rule_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as press items in up to three deliveries, judged by a rule as they come: signals with their last status."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    folder = new_dir(spark, "rule-stream")
    log = ingest.ChangeLog(spark, f"{folder}/signals", "signal_id string, raw_event_id string, name_hint string, confidence double, status string, change string")
    ledger = ingest.ChangeLog(spark, f"{folder}/ledger", ingest.LEDGER)
    for delivered, (which, title) in TITLES.items():
        rows = o.where(which).select(F.format_string("r%d", "k").alias("raw_event_id"), F.lit(delivered).cast("bigint").alias("delivered"), F.expr(title).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_date"))
        rows.write.mode("append").parquet(f"{folder}/in")
        ingest.classify_stream(ingest.file_stream(spark, f"{folder}/in", rows.schema), rules.company_statements, log, ledger, f"{folder}/checkpoint").awaitTermination()
    return log.latest("signal_id").select("signal_id", "raw_event_id", "name_hint", "status", "change")


def t03_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by day and type, a tenth of them delivered later: closed days with what came in time and what came late."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    folder = new_dir(spark, "daily-counts")
    for part in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        e.where(part).write.mode("append").parquet(f"{folder}/in")
        ingest.count_stream(lambda: ingest.file_stream(spark, f"{folder}/in", e.schema, WHOLE), f"{folder}/out", late="2 days")
    return ingest.counted(spark, f"{folder}/out").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


QUERIES = {f.__name__: f for f in (t01_upsert_stream, t02_rule_stream, t03_daily_counts)}

ORACLES = {
    "t01_upsert_stream": """WITH e AS (SELECT event_type || ':' || props AS key, event_id, value, max(event_id) OVER () AS top FROM events),
o AS (SELECT key, arg_min(value, event_id) AS payload, min(event_id) AS f, max(event_id) AS l FROM e WHERE 3 * event_id <= 2 * top GROUP BY key),
b AS (SELECT key, arg_min(value, event_id) AS payload, min(event_id) AS f, max(event_id) AS l FROM e WHERE 3 * event_id > top GROUP BY key)
SELECT coalesce(o.key, b.key) AS key, coalesce(o.payload, b.payload) AS payload, coalesce(o.f, b.f) AS first_seen, coalesce(b.l, o.l) AS last_seen FROM o FULL JOIN b ON o.key = b.key""",
    "t02_rule_stream": """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 24 = 0 THEN 'Norwind' WHEN o_orderkey % 4 = 2 THEN 'Sudwind' WHEN o_orderkey % 3 = 0 THEN 'Norwind' END AS name_hint,
 CASE WHEN o_orderkey % 24 = 0 OR o_orderkey % 4 = 2 OR (o_orderkey % 2 = 1 AND o_orderkey % 3 = 0) THEN 'active' WHEN o_orderkey % 3 = 0 THEN 'retracted' END AS status FROM orders)
SELECT 'own_incident:r' || k || ':account' AS signal_id, 'r' || k AS raw_event_id, name_hint, status,
 CASE WHEN k % 24 = 0 THEN 'restored' WHEN k % 12 = 0 THEN 'retracted' WHEN k % 12 = 6 THEN 'refreshed' ELSE 'new' END AS change FROM s WHERE status IS NOT NULL""",
    "t03_daily_counts": """WITH m AS (SELECT max(ts) FILTER (event_id % 10 <> 0) - INTERVAL 2 DAY AS mark, max(ts) - INTERVAL 2 DAY AS last FROM events),
e AS (SELECT date_trunc('day', ts) AS d, event_type, event_id % 10 = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= mark AS late FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= last)
SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM e GROUP BY ALL""",
}
