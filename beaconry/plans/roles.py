"""The engine's roles on the driver's tables, in Spark and as SQL text for the oracle side.

Orders stand for signals, customers for the watchlist, order priorities for triggers, events for raw events and
runs, labels for feedback and verdicts. Configuration (triggers, weights, rules) is stated here once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

NOW = date(2001, 8, 2)
NOW_SQL = "DATE '2001-08-02'"

TRIGGERS = [
    ("1-URGENT", "Urgent", 5, 600),
    ("2-HIGH", "High", 4, 300),
    ("3-MEDIUM", "Medium", 3, 135),
    ("4-NOT SPECIFIED", "Unspecified", 2, 90),
    ("5-LOW", "Low", 1, 0),
]
WEIGHTS = {
    ("subsector", "AUTOMOBILE"): 1.1, ("subsector", "BUILDING"): 1.05, ("subsector", "MACHINERY"): 0.95, ("subsector", "HOUSEHOLD"): 0.8,
    ("richness", "high"): 1.0, ("richness", "medium"): 0.9, ("richness", "low"): 0.75,
    ("coverage", "edgar-visible"): 1.0, ("coverage", "dark"): 0.85,
    ("applicability", "default"): 0.9, ("applicability", "BUILDING"): 0.95,
    ("scope", "account"): 1.0, ("scope", "sector"): 0.55, ("scope", "regulatory_calendar"): 0.45,
}
TIERS = ["confirmed", "corroborated", "unconfirmed_early_warning"]


def values(rows: list[tuple]) -> str:
    """Rows as an SQL VALUES list."""
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "NULL" if x is None else f"{x}e0" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.format_string("s%d", key).alias("signal_id"),
        F.format_string("r%d", key).alias("raw_event_id"),
        F.when(key % 11 != 0, F.col("o_custkey")).alias("entity_id"),
        F.col("o_orderpriority").alias("trigger_id"),
        F.element_at(F.array(*map(F.lit, ("account", "sector", "regulatory_calendar", "parent"))), (key % 4 + 1).cast("int")).alias("signal_scope"),
        F.when(key % 97 == 0, "undated").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("event_date"),
        F.when(F.col("o_orderstatus") == "P", "decayed").otherwise("active").alias("status"),
        F.when(key % 6 == 0, "confirmed").when(key % 6 == 1, "unconfirmed_early_warning").alias("tier"),
        F.concat("o_orderpriority", F.lit(" order of "), F.round("o_totalprice", 0).cast("bigint").cast("string")).alias("headline"),
        key.alias("seq"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("subsector"),
        F.when(F.col("c_nationkey") % 3 == 0, "high").when(F.col("c_nationkey") % 3 == 1, "medium").otherwise("low").alias("richness"),
        F.when(F.col("c_acctbal") < 0, "dark").otherwise("edgar-visible").alias("coverage_flag"),
        F.col("c_nationkey").alias("nation"),
    )


def triggers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRIGGERS, "trigger_id string, name string, base_strength int, half_life int")


SIGNALS = """signals AS (SELECT 's' || o_orderkey AS signal_id, 'r' || o_orderkey AS raw_event_id,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS entity_id, o_orderpriority AS trigger_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'account' WHEN 1 THEN 'sector' WHEN 2 THEN 'regulatory_calendar' ELSE 'parent' END AS signal_scope,
  CASE WHEN o_orderkey % 97 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_date,
  CASE WHEN o_orderstatus = 'P' THEN 'decayed' ELSE 'active' END AS status,
  CASE o_orderkey % 6 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'unconfirmed_early_warning' END AS tier,
  o_orderpriority || ' order of ' || CAST(round(o_totalprice) AS BIGINT) AS headline, o_orderkey AS seq FROM orders)"""
ENTITIES = """entities AS (SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS subsector,
  CASE c_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS richness,
  CASE WHEN c_acctbal < 0 THEN 'dark' ELSE 'edgar-visible' END AS coverage_flag, c_nationkey AS nation FROM customer)"""
TRIGGER_ROWS = f"triggers (trigger_id, name, base_strength, half_life) AS ({values(TRIGGERS)})"
WEIGHT_ROWS = f"weights (kind, key, w) AS ({values([(k, n, w) for (k, n), w in WEIGHTS.items()])})"
SCORED = f"""{SIGNALS}, {ENTITIES}, {TRIGGER_ROWS}, {WEIGHT_ROWS}, scored AS (
 SELECT s.*, e.subsector, e.richness, e.coverage_flag, t.base_strength::DOUBLE AS score_base,
  pow(0.5e0, greatest(coalesce(date_diff('day', try_cast(event_date AS DATE), {NOW_SQL}), 0), 0) / CASE WHEN half_life = 0 THEN 1 ELSE half_life END) AS score_decay,
  CASE WHEN s.entity_id IS NULL THEN CASE WHEN signal_scope = 'regulatory_calendar' THEN 0.9e0 ELSE 1e0 END
   ELSE coalesce(ws.w, 1e0) * CASE WHEN signal_scope = 'regulatory_calendar' THEN coalesce(wa.w, 0.9e0) ELSE coalesce(wr.w, 1e0) END * coalesce(wc.w, 1e0) END AS score_account_fit,
  coalesce(wo.w, 1e0) AS score_scope_fit
 FROM signals s JOIN triggers t USING (trigger_id) LEFT JOIN entities e ON e.entity_id = s.entity_id
 LEFT JOIN weights ws ON ws.kind = 'subsector' AND ws.key = e.subsector LEFT JOIN weights wa ON wa.kind = 'applicability' AND wa.key = e.subsector
 LEFT JOIN weights wr ON wr.kind = 'richness' AND wr.key = e.richness LEFT JOIN weights wc ON wc.kind = 'coverage' AND wc.key = e.coverage_flag
 LEFT JOIN weights wo ON wo.kind = 'scope' AND wo.key = s.signal_scope)"""
